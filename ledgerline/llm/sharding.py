"""Sharding by extendible hashing.

A document's hash leads through a directory of hash-prefix bits to a bucket; a bucket over the
byte limit splits on the next bit, others stay.  As a bucket is all documents with a prefix, its
depth is the least number of bits at which the bytes under that prefix fit the limit, or all are of one
id, which no bit can split.  So instead of inserting one by one, bytes are summed for prefixes of STEP bits,
then for all shorter prefixes of those, and each long prefix takes its first ancestor that needn't split.
Where even STEP bits don't do, the documents below go on with the next STEP bits, and so on up to MAX_DEPTH.

Everything is DataFrame operations.  The hash is of the id, so copies of a text don't share a
bucket; sums are made before the shuffle, and texts are not shuffled.

Defined cases: null text has no bytes; a null doc_id is hashed as the word "null"; rows that share a
doc_id can't be split: if they alone exceed the limit their bucket is ``oversized``, at the depth where they are
alone, and so is a single document larger than the limit; an empty table has no shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

#: Bits of the hash that are looked at together, a multiple of 4, and in all.
STEP, MAX_DEPTH = 24, 120
LIMIT = 64 << 20
_DIGITS = STEP // 4


def _hashed(docs: DataFrame) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), n_bytes.alias("n_bytes"))


def _at_step(rows: DataFrame, k: int) -> DataFrame:
    """The rows with ``above``, the digits before step k, and ``leaf``, the number that the step's digits are."""
    leaf = F.conv(F.substring("digest", k * _DIGITS + 1, _DIGITS), 16, 10).cast("long")
    return rows.select("doc_id", "n_bytes", F.substring("digest", 1, k * _DIGITS).alias("above"), leaf.alias("leaf"))


def _sums(rows: DataFrame, k: int, limit: int) -> DataFrame:
    """above, depth (within step k), prefix, shard_bytes, shard_docs, and whether the bucket splits."""
    least, most = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    leaves = _at_step(rows, k).groupBy("above", "leaf").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows"), F.count("doc_id").alias("named"), least, most)
    above = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0 if k == 0 else 1), F.lit(STEP)))).withColumn("prefix", F.expr(f"shiftright(leaf, {STEP} - depth)"))
    sums = above.groupBy("above", "depth", "prefix").agg(F.sum("n").alias("shard_bytes"), F.sum("rows").alias("shard_docs"), F.sum("named").alias("named"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)) | ((F.col("named") > 0) & (F.col("named") < F.col("shard_docs")))
    last = F.lit((k + 1) * STEP == MAX_DEPTH) & (F.col("depth") == STEP)
    return sums.select("above", "depth", "prefix", "shard_bytes", "shard_docs", ((F.col("shard_bytes") > limit) & several & ~last).alias("splits"))


def directory(docs: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """The buckets found in each step: above, depth (within the step), prefix, the bucket's bytes and documents."""
    rows, out = _hashed(docs), []
    for k in range(MAX_DEPTH // STEP):
        sums = cut(_sums(rows, k, limit))
        whole = sums.where("not splits").drop("splits")
        # A bucket is a prefix that needn't split and whose parent must; a step's first bits have such a parent.
        children = sums.where(F.col("splits") & (F.col("depth") < STEP)).select("above", (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        first = 0 if k == 0 else 1
        out.append(whole.where(F.col("depth") > first).join(children, ["above", "depth", "prefix"], "left_semi").unionByName(whole.where(F.col("depth") == first)))
        deeper = sums.where(F.col("splits") & (F.col("depth") == STEP)).select(F.concat("above", F.lpad(F.lower(F.hex("prefix")), _DIGITS, "0")).alias("open"))
        if deeper.isEmpty():
            break
        rows = rows.join(deeper, F.substring("digest", 1, (k + 1) * _DIGITS) == F.col("open"), "left_semi")
    return out


def _bits(digits: Column, n: int) -> Column:
    """The first n hexadecimal digits in bits."""
    return F.concat(F.lit(""), *[F.lpad(F.conv(F.substring(digits, at + 1, _DIGITS), 16, 2), STEP, "0") for at in range(0, n, _DIGITS)])


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard (its hash prefix in bits), shard_bytes, shard_docs, oversized.

    A document looks for its bucket at each depth that occurs in a step: a handful of numbers, 25 at most.
    """
    out = []
    for k, found in enumerate(directory(docs, limit)):
        buckets = cut(found)
        occurring = [r.depth for r in buckets.select("depth").distinct().orderBy("depth").collect()]
        keyed = _at_step(_hashed(docs), k).withColumn("depth", F.explode(F.array(*map(F.lit, occurring)).cast("array<int>"))).withColumn("prefix", F.expr(f"shiftright(leaf, {STEP} - depth)"))
        own = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
        out.append(keyed.join(buckets, ["above", "depth", "prefix"]).select(
            "doc_id", "n_bytes", (F.col("depth") + k * STEP).cast("long").alias("depth"), F.concat(_bits(F.col("above"), k * _DIGITS), own).alias("shard"),
            "shard_bytes", F.col("shard_docs").cast("long").alias("shard_docs"), (F.col("shard_bytes") > limit).alias("oversized"),
        ))
    return reduce(DataFrame.unionByName, out)


def write(docs: DataFrame, path: str, limit: int = LIMIT, shard: str = "shard") -> None:
    """Write the documents as Parquet, a folder for each shard (``shard=`` and its bits).  docs: without such a column."""
    if unused(docs, shard) != shard:
        raise ValueError(f"the documents have a column {shard!r}: give another name")
    key = unused(docs, "__id")
    at = shards(docs, limit).groupBy(F.col("doc_id").alias(key)).agg(F.first("shard").alias(shard))
    docs.join(at, F.col("doc_id").cast("long").eqNullSafe(F.col(key))).drop(key).repartition(shard).write.partitionBy(shard).parquet(path)


def oracle_sql(limit: int) -> str:
    """For tables whose ids differ in their first 60 bits of hash."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS leaf FROM documents),
above AS (SELECT doc_id, n_bytes, depth, leaf >> (60 - depth)::INT AS prefix FROM d, range(61) AS r(depth)),
sums AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) AS ids
  FROM above GROUP BY ALL),
found AS (
  SELECT d.*, s.depth, s.prefix, shard_bytes, shard_docs,
         row_number() OVER (PARTITION BY d.doc_id, d.leaf, d.n_bytes ORDER BY s.depth) AS nth
  FROM d JOIN sums s ON s.prefix = d.leaf >> (60 - s.depth)::INT
  WHERE shard_bytes <= {limit} OR ids = 1)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       shard_bytes, shard_docs, shard_bytes > {limit} AS oversized
FROM found WHERE nth = 1
"""
