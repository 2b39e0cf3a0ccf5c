"""The corpus operators as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import avi_mjpeg, byte_bpe, line_dedup, mixing, near_dup, preferences, quality_model, quality_rules, sharding, suffix_dedup
from .common import read

#: Bytes a shard of op6: small, so that test tables of a few MB make several.
SHARD_BYTES = 1 << 20


def _quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return quality_model.score(docs, quality_model.train(docs, read(spark, d, "labels")))


QUERIES = {
    "op1_avi_mjpeg": lambda spark, d: avi_mjpeg.digest(read(spark, d, "documents")),
    "op2_circulant_minhash": lambda spark, d: near_dup.near_duplicates(read(spark, d, "documents")),
    "op3_suffix_dedup": lambda spark, d: suffix_dedup.digest(read(spark, d, "documents")),
    "op4_source_mix": lambda spark, d: mixing.mixed(read(spark, d, "documents")),
    "op5_preferences": lambda spark, d: preferences.formatted(read(spark, d, "conversations")),
    "op6_extendible_shards": lambda spark, d: sharding.shards(read(spark, d, "documents"), SHARD_BYTES),
    "op7_byte_bpe": lambda spark, d: byte_bpe.digest(read(spark, d, "documents")),
    "op8_quality_model": _quality,
    "op9_line_dedup": lambda spark, d: line_dedup.digest(read(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality_rules.apply(read(spark, d, "documents"), read(spark, d, "labels")),
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op4_source_mix": mixing.ORACLE_SQL,
    "op5_preferences": preferences.ORACLE_SQL,
    "op6_extendible_shards": sharding.oracle_sql(SHARD_BYTES),
    "op9_line_dedup": line_dedup.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
