"""Stratified selection of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decade, text, trim, year_number

DEEP, STANDARD = 100, 40


def stratum(columns: list[str]) -> Column:
    """Values of the columns, with names for missing ones; ``decade`` is made from the year."""
    one = lambda c: decade(F.col("year")) if c == "decade" else F.coalesce(F.nullif(trim(text(F.col(c))), F.lit("")), F.lit("unknown" if c in ("publisher", "borough") else "∅"))
    return F.concat_ws(" · ", *[F.concat(F.lit(f"{c}="), one(c)) for c in columns])


def picks(n: Column, per: int) -> Column:
    """The ranks of ``per`` evenly spread ones of n members (half-even rounding), in order, each once."""
    if per == 1:
        return F.array(F.floor(n / 2).cast("long") + 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.bround(i * (n - 1) / F.lit(per - 1)).cast("long") + 1)
    return F.when(n <= per, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array_distinct(even))


def spread(rn: Column, n: Column, per: int) -> Column:
    """Whether the rn-th of n members is one of ``per`` evenly spread ones."""
    return F.array_contains(picks(n, per), rn.cast("long"))


def select(rows: DataFrame, strata: Column, order: list[str], per: int, cap: int | None = None) -> DataFrame:
    """``per`` members of each stratum; with a cap, strata take turns, the largest first.

    order: names of columns.  Members are counted by the first of them, so the counts tell which of its values hold a
    pick; only rows of those are ranked, by the other columns.  Ranks of strata come from their counts, a small table.
    """
    d, first = rows.withColumn("stratum", strata), order[0]
    groups = d.groupBy("stratum", F.col(first).alias("_at")).agg(F.count("*").alias("_many"))
    w = Window.partitionBy("stratum")
    groups = groups.withColumn("_before", F.sum("_many").over(w.orderBy("_at")) - F.col("_many")).withColumn("_n", F.sum("_many").over(w))
    groups = groups.withColumn("_picks", F.filter(picks(F.col("_n"), per), lambda k: (k > F.col("_before")) & (k <= F.col("_before") + F.col("_many")))).where(F.size("_picks") > 0)
    near = d.join(groups.withColumnRenamed("stratum", "_stratum"), (F.col("stratum") == F.col("_stratum")) & F.col(first).eqNullSafe(F.col("_at")))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("stratum", "_at").orderBy(*(order[1:] or [first])))
    d = near.withColumn("_rn", rank).where(F.array_contains("_picks", F.col("_rn")))
    if cap is not None:
        ranks = d.groupBy("stratum").agg(F.max("_n").alias("_size")).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_size"), "stratum"))).drop("_size")
        d = d.withColumn("_round", F.row_number().over(w.orderBy("_rn"))).join(ranks, "stratum").orderBy("_round", "_rank").limit(cap)
    return d.select(*rows.columns, "stratum")


def depth(picked: DataFrame, catalog: DataFrame) -> DataFrame:
    """deep or standard, how many lines to label, and why.

    deep: one publisher whose synthetic lines differ from real ones, and publishers whose number of columns changes.
    """
    name = lambda: F.coalesce(F.nullif(trim(text(F.col("publisher"))), F.lit("")), F.lit("unknown"))
    digits = trim(text(F.col("column_count")))
    columns = catalog.withColumn("_p", name()).groupBy("_p").agg(F.array_sort(F.collect_set(F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int")))).alias("_columns"))
    d = picked.withColumn("_p", name()).join(columns, "_p", "left")
    lain, moves = F.contains(F.lower("_p"), F.lit("lain")), (F.lower("_p") != "unknown") & (F.size("_columns") > 1)
    why = F.when(lain, "synth→real gap (Lain)").when(moves, F.concat(F.lit("col-transition ("), F.array_join(F.col("_columns").cast("array<string>"), "→"), F.lit(")"))).otherwise("")
    return d.withColumns({"depth": F.when(lain | moves, "deep").otherwise("std"), "target": F.when(lain | moves, DEEP).otherwise(STANDARD), "why": why}).drop("_p", "_columns")


def first_shuffled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of an order that the seed decides, whatever the partitions."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def by_year(rows: DataFrame) -> DataFrame:
    """The rows with ``year_number``, by which volumes are ordered before their place."""
    return rows.withColumn("year_number", year_number(F.col("year")))


def final_order(rows: DataFrame) -> DataFrame:
    """Picked volumes by publisher (those without last), then year."""
    return rows.orderBy(F.coalesce(F.nullif(F.lower(trim(text(F.col("publisher")))), F.lit("")), F.lit("~")), "year")
