"""Pages and their lines: gaps, reading order, blank pages, page-number gates, batches."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text, trim

GAP = 10


def canvas_index(path: Column) -> Column:
    """The number at the start of a file's name, or null."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(\d+)", 1).try_cast("int")


def after_gap(rows: DataFrame, group: str, index: Column, gap: int = GAP) -> DataFrame:
    """Rows after the first jump of the index by more than ``gap``; without a jump none, and all rows
    of a group in which some row has no index."""
    w = Window.partitionBy(group)
    d = rows.withColumn("_i", index).withColumn("_known", F.min(F.col("_i").isNotNull()).over(w))
    ordered = w.orderBy("_i")
    d = d.withColumn("_jump", F.coalesce(F.col("_i") - F.lag("_i").over(ordered) > gap, F.lit(False)))
    d = d.withColumn("_after", F.max("_jump").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.where("_after or not _known").drop("_i", "_known", "_jump", "_after")


def to_read(images: DataFrame, folder: str, index: Column, done: DataFrame, on: str, all_pages: bool = False, gap: int = GAP) -> DataFrame:
    """Pages of each folder to be read: those after the front matter (all where none is found), without those that are done."""
    chosen = images
    if not all_pages:
        listed = after_gap(images, folder, index, gap)
        chosen = listed.unionByName(images.join(listed.select(folder).distinct(), folder, "left_anti"))
    return chosen.join(done.select(on).distinct(), on, "left_anti")


def column_of(left: Column, right: Column, width: Column, columns: Column) -> Column:
    """Which of a page's columns holds a box's middle."""
    middle = (left + right) / 2
    return F.greatest(F.lit(0), F.least(columns - 1, F.floor(F.coalesce(F.try_divide(middle, width / columns), F.lit(0))).cast("int")))


def reading_order(lines: DataFrame, page: str, box: str, width: Column, columns: Column, by: str) -> DataFrame:
    """Lines of each page numbered from 0 by column, then top; box: left, top, right, bottom; by breaks ties."""
    d = lines.withColumn("column", column_of(F.col(box)[0], F.col(box)[2], width, columns))
    return d.withColumn("reading_pos", F.row_number().over(Window.partitionBy(page).orderBy("column", F.col(box)[1], by)) - 1)


def readable(lines: DataFrame, least: float, line: str = "text", confidence: str = "confidence") -> DataFrame:
    return lines.where((F.coalesce(F.col(confidence), F.lit(1.0)) >= least) & (trim(text(F.col(line))) != ""))


def column_count(override: Column, catalog: Column) -> Column:
    """An override, else the catalog's digits, else 1."""
    return F.coalesce(override, F.when(trim(text(catalog)).rlike("^[0-9]+$"), trim(catalog).try_cast("int")), F.lit(1))


def grey_deviation(content: Column) -> Column:
    """status and the standard deviation of an image's grey values; status says why there is none: ``broken``, or ``no image library``."""

    @F.pandas_udf("status string, deviation double")
    def deviation(files: pd.Series) -> pd.DataFrame:
        try:
            import numpy as np
            from PIL import Image
        except ImportError:
            return pd.DataFrame({"status": ["no image library"] * len(files), "deviation": [None] * len(files)}).astype({"deviation": "float64"})

        def one(data):
            try:
                return "ok", float(np.asarray(Image.open(io.BytesIO(data)).convert("L"), dtype="float64").std())
            except (OSError, ValueError, SyntaxError, TypeError):
                return "broken", None

        return pd.DataFrame([one(x) for x in files], columns=["status", "deviation"]).astype({"deviation": "float64"})

    return deviation(content)


def is_blank(pixels: Column, threshold: float = 12.0) -> Column:
    """Whether an array of grey values hardly varies."""
    n = F.size(pixels)
    total = lambda f: F.aggregate(pixels, F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / n
    return F.sqrt(F.greatest(total(lambda x: x * x) / n - mean * mean, F.lit(0.0))) < threshold


def page_offset(printed: Column, leaf: Column, total: Column) -> Column:
    """leaf - printed where that is plausible, else null."""
    ok = (printed > 0) & (total.isNull() | (total == 0) | (printed <= total)) & (leaf - printed).between(-25, 60)
    return F.when(ok, leaf - printed)


def gate(reads: DataFrame) -> DataFrame:
    """Offset of each volume from its two sample pages, or ESCALATE."""
    d = reads.withColumn("page_offset", F.coalesce(page_offset(F.col("page1_printed_page"), F.col("l1"), F.col("total")), page_offset(F.col("page2_printed_page"), F.col("l2"), F.col("total"))))
    return d.withColumn("offset_status", F.when(F.col("page_offset").isNotNull(), "ok").otherwise("ESCALATE"))


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Batch numbers within each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))


def crop_box(box: Column, width: Column, height: Column, pad: int = 6) -> Column:
    """A padded box that stays on the page."""
    return F.struct(
        F.greatest(box[0] - pad, F.lit(0)).alias("left"), F.greatest(box[1] - pad, F.lit(0)).alias("top"),
        F.least(box[2] + pad, width).alias("right"), F.least(box[3] + pad, height).alias("bottom"),
    )


def top_spans(spans: DataFrame, key: str, label: str = "label", score: str = "score", pos: str = "pos", value: str = "text") -> DataFrame:
    """The span of highest score for each label; of equal scores the first."""
    return spans.groupBy(key, label).agg(F.max_by(value, F.struct(F.col(score), -F.col(pos))).alias(value))


def assembled(spans: DataFrame, key: str) -> DataFrame:
    """Spans as records: one row a key with the eight fields."""
    from ..functions.text import looks_firm

    # Labels of spans and the fields that they fill.
    labels = {"person name": "name", "spouse": "spouse_name", "race": "race_designation", "occupation": "occupation_role", "employer": "employer", "address": "address", "home address": "home_address"}
    wide = top_spans(spans, key).groupBy(key).pivot("label", list(labels)).agg(F.first("text"))
    names = {f: text(F.col(f"`{k}`")) for k, f in labels.items()}
    order = ["name", "is_business", "spouse_name", "race_designation", "occupation_role", "employer", "address", "home_address"]
    return wide.select(key, *[(looks_firm(names["name"]) if f == "is_business" else names[f]).alias(f) for f in order])
