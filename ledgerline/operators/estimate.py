"""Estimates of training runs from model shape, GPU and number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hidden size, layers, 1e9 parameters; speed against the anchor, memory, dollars an hour.
SIZES = [("0.8B", 1024, 24, 0.8), ("2B", 2048, 24, 2.2), ("4B", 2560, 36, 4.3)]
GPUS = [("h200", 2.0, 141.0, None), ("h100", 1.8, 80.0, None), ("rtx-pro-6000", 1.49, 96.0, 2.75), ("a100", 1.0, 80.0, 2.50), ("l40s", 0.65, 48.0, None)]
VOCABULARY, SEQUENCE, ANCHOR, PACKING, BUDGET = 248_320, 512, 21.1, 1.2, 0.9


def logits_gb(batch: Column) -> Column:
    return batch.cast("long") * SEQUENCE * VOCABULARY * 7 / 1e9


def weights_gb(params: Column) -> Column:
    return params * 2 * 1.15


def activations_gb(hidden: Column, layers: Column, batch: Column) -> Column:
    return hidden * layers * batch.cast("long") * SEQUENCE * 16 / 1e9


def vram_gb(params: Column, hidden: Column, layers: Column, batch: Column) -> Column:
    return weights_gb(params) + logits_gb(batch) + activations_gb(hidden, layers, batch)


def compute(hidden: Column, layers: Column) -> Column:
    return 12 * hidden * hidden * layers + 2 * hidden * VOCABULARY


def compute_ratio(hidden: Column, layers: Column) -> Column:
    _, h, n, _ = SIZES[0]
    return compute(hidden, layers) / F.lit(12 * h * h * n + 2 * h * VOCABULARY)


def grid(spark: SparkSession) -> DataFrame:
    """Every size with every GPU: fifteen rows."""
    sizes = spark.createDataFrame(SIZES, "size string, hidden long, layers long, params double")
    gpus = spark.createDataFrame(GPUS, "gpu string, speed double, memory double, rate double")
    return sizes.crossJoin(gpus)


def estimate(rows: DataFrame, n: Column, epochs: Column, packing: bool = True, measured: Column | None = None, limit_hours: int = 24) -> DataFrame:
    """batch, vram, samples a second, hours, cost and jobs of rows with hidden, layers, params, speed, memory, rate."""
    size = [F.col("params"), F.col("hidden"), F.col("layers")]
    batch = F.coalesce(F.array_max(F.filter(F.array(*[F.lit(1 << k) for k in range(7)]), lambda b: vram_gb(*size, b) <= F.col("memory") * BUDGET)), F.lit(1))
    d = rows.withColumn("batch", batch).withColumn("vram", vram_gb(*size, F.col("batch")))
    base = F.coalesce(measured, F.lit(ANCHOR) * F.col("speed")) if measured is not None else F.lit(ANCHOR) * F.col("speed")
    speed = base / compute_ratio(F.col("hidden"), F.col("layers")) * (PACKING if packing else 1.0)
    d = d.withColumn("sps", F.when(F.col("batch") < 64, speed * F.pow(F.col("batch") / 64, F.lit(0.25))).otherwise(speed))
    d = d.withColumn("hours", n * epochs / F.col("sps") / 3600)
    return d.withColumn("cost", F.col("hours") * F.col("rate")).withColumn("jobs", F.greatest(F.lit(1), F.ceil(F.floor("hours") / limit_hours)))
