"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import to_pipe, to_yaml
from ..functions.text import text, trim
from ..operators.catalog import filled
from ..operators.convert import pseudo_gold
from ..operators.pools import merge
from ..schema import CATALOG, TEXT_FIELDS


def examples(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of JSON; empty fields stay."""
    df.select("raw_line", "context", "record").write.mode(mode).option("ignoreNullFields", False).json(path)


def append_rows(df: DataFrame, path: str, columns: list[str] = CATALOG) -> None:
    """Rows at the end of a table: a folder of parts, each with the header, so that any of them is a table by itself.

    Missing columns are empty; a folder that isn't there is made.
    """
    filled(df, columns).write.mode("append").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def with_column_after(df: DataFrame, column: str, after: str) -> DataFrame:
    """The columns in order with ``column`` behind ``after``; to be written to a new path."""
    names = [c for c in df.columns if c != column]
    names.insert(names.index(after) + 1, column)
    return df.select(*names)


def pool(old: DataFrame, new: DataFrame, path: str) -> None:
    """Added counts, the largest first, terms between tabs; parts are in order of their names."""
    merge(old, new).orderBy(F.desc("count"), "term").write.mode("errorifexists").option("sep", "\t").option("quote", "").csv(path)


def predictions(df: DataFrame, path: str, target: str = "yaml") -> None:
    """Predicted records in the order of row_id: lines, or blocks between empty lines.

    Parts are in order of their names; put end to end they are the prediction file.
    """
    record = F.struct(*[c for c in df.columns if c != "row_id"])
    value = to_pipe(record) if target == "pipe" else to_yaml(record)
    df.select("row_id", value.alias("value")).orderBy("row_id").select("value").write.text(path, lineSep="\n" if target == "pipe" else "\n\n")


def run_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("ignoreNullFields", False).json(path)


def lines(df: DataFrame, order: str, value: str, path: str) -> None:
    """Rendered text (tables, worklists) in order, also of the parts' names."""
    df.orderBy(order).select(F.col(value).alias("value")).write.text(path)


def worklist(df: DataFrame, *more: str) -> DataFrame:
    """One Markdown line for each selected volume, beside its id and the named columns."""
    cell = lambda c: F.regexp_replace(text(F.col(c)), r"\|", "/")
    return df.select("id", *more, F.concat(F.lit("| "), F.concat_ws(" | ", cell("publisher"), cell("year"), cell("id"), cell("title")), F.lit(" |")).alias("line"))


def page_ocr(df: DataFrame) -> DataFrame:
    """file, json and plain text of each page."""
    return df.select("file", F.to_json(F.struct("image_width", "image_height", "lines")).alias("json"), F.array_join(F.transform("lines", lambda x: text(x["text"])), "\n").alias("text"))


def editor_payload(df: DataFrame, *columns: str) -> DataFrame:
    """The JSON that a page editor is fed with, a row for each page."""
    return df.select(F.to_json(F.struct(*columns)).alias("payload"))


def editor_export(df: DataFrame) -> DataFrame:
    """Edited entries that weren't skipped and have a name, trimmed."""
    record = F.struct(*[(trim(text(F.col(f"record.{f}"))) if f in TEXT_FIELDS else F.coalesce(F.col(f"record.{f}"), F.lit(False))).alias(f) for f in ["name", "is_business", *TEXT_FIELDS[1:]]])
    kept = df.where(~F.coalesce("skipped", F.lit(False)) & (trim(text(F.col("record.name"))) != ""))
    return kept.select(trim(F.col("raw_line")).alias("raw_line"), "context", record.alias("record"))


def pseudo(df: DataFrame, path: str, line: str = "line") -> None:
    examples(pseudo_gold(df, line), path)


def archive(responses: DataFrame, archived: DataFrame, key: str, path: str) -> None:
    """Responses that the archive lacks, once each."""
    responses.join(archived.select(key).distinct(), key, "left_anti").dropDuplicates([key]).write.mode("append").json(path)
