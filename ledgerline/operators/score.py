"""Predictions against gold records: tallies, precision, recall, F1 and whole-row exactness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, text, trim
from ..schema import FIELDS


def zipped(gold: DataFrame, pred: DataFrame, key: str = "row_id", missing_as_empty: bool = True) -> DataFrame:
    """Gold and predicted records of the same row; a missing prediction is empty, or its row is left out."""
    g = gold.select(key, F.struct(*[c for c in gold.columns if c != key]).alias("gold"))
    p = pred.select(key, F.struct(*[c for c in pred.columns if c != key]).alias("pred"))
    return g.join(p, key, "left" if missing_as_empty else "inner")


def as_text(value: Column, kind: str, missing: str = "") -> Column:
    return F.when(value.isNull(), F.lit(missing)).when(value, "True").otherwise("False") if kind == "boolean" else text(value)


def cells(pairs: DataFrame, fields: list[str] = FIELDS, strict: bool = False) -> DataFrame:
    """field, g, p, eq for each row and field, and exact: whether all fields of the row are equal."""
    kinds = {side: dict(pairs.select(f"{side}.*").dtypes) for side in ("gold", "pred")}

    def one(f):
        # A gold boolean is never empty; a predicted one is when its row is missing.
        g = as_text(F.col("gold")[f], kinds["gold"][f], "False")
        p = as_text(F.col("pred")[f], kinds["pred"][f])
        return F.struct(F.lit(f).alias("field"), g.alias("g"), p.alias("p"), (norm(g, strict) == norm(p, strict)).alias("eq"))

    out = pairs.withColumn("cells", F.array(*map(one, fields)))
    return out.withColumn("exact", F.forall("cells", lambda c: c["eq"]))


def tallies(pairs: DataFrame, fields: list[str] = FIELDS, strict: bool = False) -> DataFrame:
    """n, em, gold_ne, pred_ne, correct_ne of each field; whether a cell is empty is asked of the plain text."""
    rows = cells(pairs, fields, strict).select(F.inline("cells"))
    gold, pred = trim(F.col("g")) != "", trim(F.col("p")) != ""
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_if("eq").alias("em"), F.count_if(gold).alias("gold_ne"), F.count_if(pred).alias("pred_ne"), F.count_if(gold & F.col("eq")).alias("correct_ne"))


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def field_metrics(pairs: DataFrame, fields: list[str] = FIELDS, strict: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A row for each field; figures of excluded fields are null.  Unrounded figures end in ``_raw``."""
    t = tallies(pairs, fields, strict).withColumn("excluded", F.col("field").isin(*exclude) if exclude else F.lit(False))
    t = t.withColumn("p_raw", ratio(F.col("correct_ne"), F.col("pred_ne"))).withColumn("r_raw", ratio(F.col("correct_ne"), F.col("gold_ne")))
    t = t.withColumn("f1_raw", f1(F.col("p_raw"), F.col("r_raw"))).withColumn("applicable", F.col("gold_ne") > 0)
    shown = lambda x, d: F.when(~F.col("excluded"), F.bround(x, d))
    return t.withColumns({"em_pct": shown(ratio(100.0 * F.col("em"), F.greatest(F.col("n"), F.lit(1))), 1), "p": shown(F.col("p_raw"), 3), "r": shown(F.col("r_raw"), 3), "f1": shown(F.col("f1_raw"), 3)})


def overall(pairs: DataFrame, fields: list[str] = FIELDS, strict: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row: n, row_exact_pct, macro_f1, micro_f1, fields_scored, spurious_fields, excluded_fields."""
    kept = [f for f in fields if f not in exclude]
    m = field_metrics(pairs, kept, strict)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = m.agg(
        F.avg(F.when(F.col("applicable"), F.col("f1_raw"))).alias("macro"), total("correct_ne").alias("c"), total("pred_ne").alias("pn"), total("gold_ne").alias("gn"),
        F.count_if("applicable").alias("fields_scored"),
        F.array_sort(F.collect_list(F.when(~F.col("applicable") & (F.col("pred_ne") > 0), F.col("field")))).alias("spurious_fields"),
    )
    rows = cells(pairs, kept, strict).agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))
    micro = f1(ratio(F.col("c"), F.col("pn")), ratio(F.col("c"), F.col("gn")))
    return rows.crossJoin(a).select(  # one row each
        "n", F.bround(ratio(100.0 * F.col("exact"), F.greatest("n", F.lit(1))), 1).alias("row_exact_pct"), F.bround(F.coalesce("macro", F.lit(0.0)), 3).alias("macro_f1"),
        F.bround(micro, 3).alias("micro_f1"), "fields_scored", "spurious_fields", F.array(*map(F.lit, exclude)).cast("array<string>").alias("excluded_fields"),
    )


def run_row(pairs: DataFrame, label: str, gold: str, pred: str, timestamp: str, strict: bool = False, exclude: tuple[str, ...] = (), fields: list[str] = FIELDS) -> DataFrame:
    """One row of the metrics log."""
    m = field_metrics(pairs, fields, strict, exclude)
    each = F.struct(F.col("em_pct").alias("em"), "p", "r", "f1", "gold_ne", "pred_ne", "applicable", "excluded")
    per_field = m.agg(F.map_from_entries(F.collect_list(F.struct("field", each))).alias("per_field"))
    heads = {"timestamp": timestamp, "label": label, "gold": gold, "pred": pred, "strict": strict}
    return overall(pairs, fields, strict, exclude).crossJoin(per_field).withColumns({k: F.lit(v) for k, v in heads.items()})


def derived_fields_warning(gold_path: str, exclude: tuple[str, ...]) -> str | None:
    """Gold sets whose fields are partly derived by rule should be scored without those."""
    return "some gold fields are derived by rule: name them in exclude" if "derived" in gold_path and not exclude else None


def bar(share: Column) -> Column:
    k = F.bround(share * 5).cast("int")
    return F.rpad(F.repeat(F.lit("#"), k), 5, ".")


def report(metrics: DataFrame) -> DataFrame:
    """A text line for each field."""
    return metrics.select("field", F.format_string("%-18s P %.3f  R %.3f  F1 %.3f  %s", "field", "p_raw", "r_raw", "f1_raw", bar(F.col("f1_raw"))).alias("line"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Line-weighted mean of volumes' figures."""
    return rows.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(f"{value}_weighted"), F.sum(weight).alias("lines"))
