"""Append-only logs and staged merges as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import filled, keys, new_rows
from ..schema import METRICS


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METRICS).json(path)


def last_runs(log: DataFrame) -> DataFrame:
    """The last run of each gold set and label; to be written in update or complete mode."""
    run = F.struct("macro_f1", "micro_f1", "row_exact_pct")
    return log.groupBy("gold", "label").agg(F.max_by(run, "timestamp").alias("run")).select("gold", "label", "run.*")


def once(rows: DataFrame, at: str, key: list[str], within: str = "1 hour") -> DataFrame:
    """Rows whose key did not come before within that time."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def merge_into(pending: DataFrame, master: str, checkpoint: str):
    """Append each batch's new keys to the master table; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(master)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        d = filled(batch).withColumn("_pos", F.monotonically_increasing_id())
        known = spark.read.parquet(master) if there else batch.limit(0).transform(filled)
        fresh = new_rows(d, "_pos", known, trimmed=True).drop("_pos")
        fresh.write.mode("append").parquet(master)

    return pending.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


__all__ = ["keys", "last_runs", "merge_into", "once", "run_log", "windowed_counts"]
