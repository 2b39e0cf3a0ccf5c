"""The catalog of volumes: keys, duplicates, staged merges, enrichment, contributors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boroughs, held_out, parse_publisher, parse_year, text, trim
from ..schema import CATALOG


def make_row(source: Column, ident: Column, title: Column, year_hint: Column, city: Column, institution: Column) -> list[Column]:
    """The catalog's columns from what a source says."""
    title = trim(text(title))
    year, publisher = parse_year(F.trim(F.concat_ws(" ", text(year_hint), title))), parse_publisher(title)
    known = {"source": source, "id": ident, "publisher": publisher, "city": text(city), "year": year, "holding_institution": text(institution), "title": F.substring(title, 1, 200), "notes": held_out(publisher, year)}
    return [known.get(c, F.lit("")).alias(c) for c in CATALOG]


def key(df: DataFrame, trimmed: bool = True) -> list[Column]:
    """Lower-case source and id; both trimmed, but for rows that were just made."""
    clean = trim if trimmed else (lambda x: x)
    return [F.lower(clean(text(F.col("source")))).alias("_source"), clean(text(F.col("id"))).alias("_id")]


def keys(df: DataFrame) -> DataFrame:
    return df.select(*key(df)).distinct()


def new_rows(fresh: DataFrame, pos: str, *known: DataFrame, trimmed: bool = False) -> DataFrame:
    """The first of fresh rows for each key that no known table has; rows without id are skipped."""
    have = reduce(DataFrame.unionByName, map(keys, known)).distinct()
    d = fresh.select("*", *key(fresh, trimmed)).where(trim(F.col("_id")) != "").join(have, ["_source", "_id"], "left_anti")
    return d.groupBy("_source", "_id").agg(F.min_by(F.struct(*fresh.columns), pos).alias("_first")).select("_first.*")


def filled(df: DataFrame, columns: list[str] = CATALOG) -> DataFrame:
    """The columns in order; missing ones and nulls as ''."""
    return df.select(*[(text(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in columns])


def merge_pending(master: DataFrame, pending: DataFrame, pos: str) -> tuple[DataFrame, DataFrame]:
    """The master with the pending rows that are new, and what stays pending: all of it if nothing was new.

    Emptiness is a join condition, so nothing has to be counted before writing.
    """
    new = new_rows(pending, pos, master, trimmed=True)
    some = new.select(F.lit(1).alias("_some")).limit(1)
    left = pending.join(some, F.lit(True), "left_anti")
    return filled(master).unionByName(filled(new)), left


def index_by_id(df: DataFrame, pos: str, ident: str = "id") -> DataFrame:
    """One row for each id: the last."""
    return df.groupBy(F.col(ident).alias("_key")).agg(F.max_by(F.struct(*df.columns), pos).alias("_last")).select("_last.*")


def enrich(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Fill blanks from fetched metadata, and look again for held-out volumes.

    found: the key, publisher_text, year_text, title_text, and error (null if the fetch went well).
    Nothing that is filled is overwritten.
    """
    names = ["publisher_text", "year_text", "title_text", "error"]
    d = rows.join(found.select(*on, *[F.col(n).alias(f"_{n}") for n in names]), on, "left")
    got = F.col("_error").isNull() & F.coalesce("_publisher_text", "_year_text", "_title_text").isNotNull()
    fill = lambda c, new: F.when(got & (text(F.col(c)) == ""), new).otherwise(text(F.col(c)))
    known = parse_publisher(text(F.col("_publisher_text")))
    d = d.withColumns({
        "publisher": fill("publisher", F.when(known != "", known).otherwise(trim(text(F.col("_publisher_text"))))), "year": fill("year", parse_year(text(F.col("_year_text")))),
        "title": fill("title", F.substring(text(F.col("_title_text")), 1, 200)), "notes": text(F.col("notes")),
    })
    named = boroughs(F.col("title"))
    joined = lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit(" | "), b))
    span = F.concat(F.lit("covers "), F.array_join(F.array_sort(named), ", "))
    open_ = got & (text(F.col("borough")) == "")
    d = d.withColumn("notes", F.when(open_ & (F.size(named) > 1) & ~F.contains("notes", F.lit("covers ")), F.when(F.col("notes") == "", span).otherwise(F.concat("notes", F.lit(" | "), span))).otherwise(F.col("notes")))
    d = d.withColumn("borough", F.when(open_ & (F.size(named) == 1), F.get(named, F.lit(0))).otherwise(text(F.col("borough"))))
    flag = held_out(F.col("publisher"), F.col("year"))
    d = d.withColumn("notes", F.when(got & (flag != "") & ~F.startswith("notes", F.lit("REVIEW")), joined(flag, F.col("notes"))).when(F.col("_error").isNotNull(), joined(F.lit("enrich failed"), F.col("notes"))).otherwise(F.col("notes")))
    return d.drop(*[f"_{n}" for n in names])


# Institutions as sources name them, and what stands for one where none is named.
INSTITUTIONS = {
    "brooklyn public library, brooklyn collection": "Brooklyn Public Library",
    "brooklyn public library": "Brooklyn Public Library",
    "allen county public library genealogy center": "Allen County Public Library",
    "columbia university libraries": "Columbia University Libraries",
    "the new york public library": "New York Public Library",
}
FALLBACKS = [
    ("uploader", "bklynlibrary.org", "Brooklyn Public Library"),
    ("collection", "brooklynpubliclibrary", "Brooklyn Public Library"),
    ("collection", "durstoldyorklibrary", "Columbia University Libraries"),
    ("collection", "allen_county", "Allen County Public Library"),
]
SOURCE_DEFAULTS = {"nypl": "New York Public Library", "loc": "Library of Congress"}


def institution(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INSTITUTIONS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(trim(raw))), trim(raw))


def resolve(meta: DataFrame) -> DataFrame:
    """id, institution and how; meta: id, contributor, uploader, collection as arrays of text."""
    first = trim(text(F.get("contributor", F.lit(0))))
    name, how = F.when(first != "", institution(first)), F.when(first != "", F.lit("contributor"))
    for field, needle, found in FALLBACKS:
        hit = F.contains(F.lower(F.array_join(F.coalesce(F.col(field), F.array()), " ")), F.lit(needle))
        name, how = name.when(hit, found), how.when(hit, field)
    return meta.select("id", name.alias("institution"), how.alias("how"))


def backfill(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """contributing_institution by source: a constant, what was resolved, or what a curator wrote."""
    d = rows.join(resolved.select("id", F.col("institution").alias("_found")), "id", "left")
    value = F.when(F.col("source") == "ia", text(F.col("_found")))
    for source, name in SOURCE_DEFAULTS.items():
        value = value.when(F.col("source") == source, name)
    curated = F.coalesce(F.nullif(text(F.col("contributing_institution")), F.lit("")), text(F.col("holding_institution")))
    return d.withColumn("contributing_institution", value.otherwise(curated)).drop("_found").select(*rows.columns)


def contributor_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contributing_institution").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contributing_institution")


def to_fetch(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct ids that no cache has."""
    return rows.select("id").distinct().join(cache.select("id"), "id", "left_anti").orderBy("id")


def picker(rows: DataFrame, pos: str, n: int) -> DataFrame:
    """The first n volumes of one publisher that lack a column count."""
    open_ = F.contains(F.lower(text(F.col("publisher"))), F.lit("trow")) & (trim(text(F.col("column_count"))) == "") & (trim(text(F.col("id"))) != "")
    return rows.where(open_).orderBy(pos).limit(n)


# Notes that take a volume out.
EXCLUDED = r"(?i)phonebook|\bbiz\b|eval|holdout|held[- ]out|keep out"


def in_scope() -> Column:
    """An id, and no note that excludes the volume (``eval`` counts within words too)."""
    return (trim(text(F.col("id"))) != "") & ~text(F.col("notes")).rlike(EXCLUDED)
