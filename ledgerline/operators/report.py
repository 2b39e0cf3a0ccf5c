"""Comparison tables from logs in which a later run replaces an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eval_name(path: Column) -> Column:
    """The evaluation set's name: its file's name without ending, or its folder's if that is ``gold``."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"(_eval|_gold)$", "")


def last_wins(log: DataFrame, rows: str, columns: str, values: list[str], at: Column, labels: list[str]) -> DataFrame:
    """A row for each ``rows``, a column for each label, of the last run's values.

    labels are listed, so that Spark needn't collect them first; a value is kept in a struct, as a
    null in the last run must not give way to an earlier run's value.
    """
    return log.groupBy(rows).pivot(columns, labels).agg(F.max_by(F.struct(*values), at))


def markdown(table: DataFrame, rows: str, labels: list[str], value: str, digits: int = 3) -> DataFrame:
    """One Markdown line for each row; absent values are a dash."""
    cells = [F.coalesce(F.format_number(F.col(f"`{x}`.{value}"), digits), F.lit("—")) for x in labels]
    return table.select(rows, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(rows), *cells), F.lit(" |")).alias("line"))
