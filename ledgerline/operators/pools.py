"""Weighted pools of terms: counted, merged, tempered, drawn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import parse_yaml
from ..functions.text import blank, clean_occupation, name_token, recase, safe_double, text, trim, truthy


def names(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of surnames and of given names in entries that aren't firms, of either version."""
    words = F.filter(F.split(text(F.col("name")), r"(?U)\s+"), lambda x: x != "")
    surname = F.coalesce(blank(F.col("surname")), F.get(words, F.lit(0)), F.lit(""))
    given = F.when(blank(F.col("surname")).isNotNull(), F.split(text(F.col("given_name")), r"(?U)\s+")).otherwise(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))))
    d = entries.where(~truthy(F.col("is_business"), short=True)).select(F.btrim(surname, F.lit(" ,.")).alias("surname"), given.alias("given"))
    surnames = count(d.select(F.col("surname").alias("term")).where(name_token(F.col("term"))))
    givens = d.select(F.explode("given").alias("term")).select(F.btrim("term", F.lit(" ,")).alias("term")).where(name_token(F.col("term")))
    return surnames, count(givens.select(F.rtrim("term", F.lit(".")).alias("term")))


def count(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("count"))


def merge(*pools: DataFrame) -> DataFrame:
    """Counts of equal terms added."""
    return reduce(DataFrame.unionByName, [p.select("term", "count") for p in pools]).groupBy("term").agg(F.sum("count").alias("count"))


def most_common(terms: DataFrame, pos: str, n: int | None = None) -> DataFrame:
    """Terms by falling count; of equal counts the first seen."""
    d = terms.groupBy("term").agg(F.count("*").alias("count"), F.min(pos).alias("first_pos")).orderBy(F.desc("count"), "first_pos")
    return d.limit(n) if n else d


def occupations(blocks: DataFrame, block: str) -> DataFrame:
    """Counts of cleaned occupations in predicted blocks.

    White space after the colon may cross the line's end here: an empty value then reads as the next line, and its
    colon makes the cleaner drop it.
    """
    value = F.btrim(F.regexp_extract(text(F.col(block)), r"(?m)^occupation_role:\s*(.*)$", 1), F.lit('"'))
    return count(blocks.select(clean_occupation(value).alias("term")).where("term <> ''"))


def census(table: DataFrame, pos: str, n: int) -> DataFrame:
    """The n most frequent surnames, recased; suppressed shares count as 0, mostly Hispanic or Asian names are left out."""
    share = lambda c: safe_double(F.col(c))
    keep = (F.upper(trim(F.col("name"))) != "ALL OTHER NAMES") & (safe_double(F.col("count")) > 0) & (share("pcthispanic") < 50) & (share("pctapi") < 50)
    return table.where(keep).orderBy(safe_double(F.col("count")).desc(), pos).limit(n).select(recase(F.col("name")).alias("term"), safe_double(F.col("count")).cast("long").alias("count"))


def tempered(base: DataFrame, harvested: DataFrame, power: float = 0.3, boost: float = 8.0, boost_power: float = 0.5) -> DataFrame:
    """weight = base ^ power + boost * harvested ^ boost_power."""
    b, h = base.select("term", F.col("count").alias("b")), harvested.select("term", F.col("count").alias("h"))
    zero = F.lit(0)
    weight = F.when(F.col("b").isNotNull(), F.pow("b", F.lit(power))).otherwise(zero) + F.when(F.col("h").isNotNull(), boost * F.pow("h", F.lit(boost_power))).otherwise(zero)
    return b.join(h, "term", "full").select("term", weight.alias("weight"))


def blended(curated: DataFrame, harvested: DataFrame, share: float = 0.35) -> DataFrame:
    """Curated terms, and harvested ones that aren't curated, scaled to a share of the curated weight."""
    extra = harvested.withColumn("_k", F.lower("term")).join(curated.select(F.lower("term").alias("_k")).distinct(), "_k", "left_anti")
    mass, total = curated.agg(F.sum("weight").alias("_mass")), extra.agg(F.sum("count").alias("_total"))
    scaled = extra.join(mass.crossJoin(total), F.lit(True)).select("term", (F.col("count") * share * F.col("_mass") / F.col("_total")).alias("weight"))  # one row of sums
    return curated.select("term", "weight").unionByName(scaled)


def cumulative(pool: DataFrame) -> DataFrame:
    """term, lo, hi: the part of [0, 1) that draws the term, in order of terms.

    Weights are summed by the terms' first characters, then within those, so no task gets the whole pool.
    """
    d = pool.withColumn("_head", F.substring("term", 1, 2))
    heads = d.groupBy("_head").agg(F.sum("weight").alias("_sum"))
    upto = F.sum("_sum").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = heads.withColumn("_offset", upto - F.col("_sum")).withColumn("_total", F.sum("_sum").over(Window.partitionBy()))
    inside = F.sum("weight").over(Window.partitionBy("_head").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hi = F.col("_offset") + inside
    return d.join(heads, "_head").select("term", ((hi - F.col("weight")) / F.col("_total")).alias("lo"), (hi / F.col("_total")).alias("hi"))


def draw(rows: DataFrame, u: Column, pool: DataFrame, name: str, buckets: int = 4096) -> DataFrame:
    """Each row's term: the one whose part holds its number u in [0, 1).

    Both sides are cut in buckets of [0, 1) so that this is an equi-join, and only terms of one bucket are compared.
    """
    c = cumulative(pool).where("hi > lo")
    c = c.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1)))))
    d = rows.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets))
    joined = d.join(c.select(F.col("term").alias(name), "lo", "hi", "_b"), "_b").where("_u >= lo and _u < hi")
    return joined.drop("_u", "_b", "lo", "hi")


def yaml_records(blocks: DataFrame, block: str) -> DataFrame:
    return blocks.select("*", parse_yaml(F.col(block)).alias("record"))
