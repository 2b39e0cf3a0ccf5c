"""Joins by containment and by likeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text, tokens, trim

#: Needles, and bytes of them, that are sent to all executors and looked for one by one; more go through grams.
FEW, SMALL = 256, 1 << 20
#: Characters of a gram; shorter needles are grams of their own length.
GRAM = 8


def _small(needles: DataFrame, needle: str) -> bool:
    """Whether the needles are few and their text small: a checked size, not a guess."""
    size = needles.agg(F.count("*").alias("n"), F.sum(F.octet_length(needle)).alias("bytes")).first()
    return size.n <= FEW and (size.bytes or 0) <= SMALL


def _grams(c: Column, size: Column) -> Column:
    """Hashes of the distinct runs of ``size`` characters."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    starts = F.when(F.size(chars) >= size, F.sequence(F.lit(1), F.size(chars) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(chars, i, size))))


def contained(rows: DataFrame, key: str, text_column: str, needles: DataFrame, needle: str, fold: bool = False) -> DataFrame:
    """key and the needle's columns, once each, where the needle occurs in the text of a row of that key.

    Few needles are broadcast.  Of many, each is looked for by its rarest gram, as counted in the texts: only hashes of
    grams and keys are shuffled, and only candidates meet their texts again.  Blank needles occur nowhere.
    """
    hay, pin = text(F.col(text_column)), F.col(needle)
    if fold:
        hay, pin = F.lower(hay), F.lower(pin)
    rows, pins = rows.select(key, hay.alias("_hay")), needles.where(trim(F.col(needle)) != "").distinct().withColumn("_pin", pin)
    if _small(pins, needle):
        return rows.join(F.broadcast(pins), F.contains("_hay", F.col("_pin"))).select(key, *needles.columns).distinct()
    size = F.least(F.length("_pin"), F.lit(GRAM))
    lengths = [r[0] for r in pins.select(size).distinct().collect()]  # GRAM numbers at most
    offered = rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("_hay"), F.lit(n)) for n in sorted(lengths)])))).alias("gram"))
    held = pins.select("_pin").distinct().select("_pin", F.explode(_grams(F.col("_pin"), size)).alias("gram"))
    hits = offered.join(held.select("gram").distinct(), "gram", "left_semi")
    counted = hits.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = held.join(counted, "gram").groupBy("_pin").agg(F.min(F.struct("n", "gram")).alias("least")).select("_pin", F.col("least.gram").alias("gram"))
    found = hits.join(rarest, "gram").select(key, "_pin").distinct()
    found = found.join(rows, key).where(F.contains("_hay", F.col("_pin"))).select(key, "_pin").distinct()
    return found.join(pins, "_pin").select(key, *needles.columns)


def longest_contained(rows: DataFrame, key: str, text_column: str, needles: DataFrame, needle: str, pos: str, fold: bool = False) -> DataFrame:
    """For each key the longest needle in its text; of equally long ones the first."""
    pairs = contained(rows, key, text_column, needles.select(needle, pos), needle, fold)
    return pairs.groupBy(key).agg(F.max_by(needle, F.struct(F.length(needle), -F.col(pos))).alias(needle))


def having_any(rows: DataFrame, key: str, text_column: str, needles: DataFrame, needle: str, fold: bool = False) -> DataFrame:
    """Rows whose text has one of the needles."""
    pairs = contained(rows, key, text_column, needles.select(needle), needle, fold)
    return rows.join(pairs.select(key).distinct(), key, "left_semi")


def selected_folders(folders: DataFrame, key: str, hay: str, ids: DataFrame, use_worklist: bool = True) -> DataFrame:
    """Folders in whose haystack one of the worklist's ids occurs, whatever the case; none if the worklist is empty."""
    return having_any(folders, key, hay, ids, "id", fold=True) if use_worklist else folders


def missing_from(rows: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    """Rows whose path is not in the listing."""
    return rows.join(listing.select(on).distinct(), on, "left_anti")


def greedy_match(records: DataFrame, entries: DataFrame, group: str, pos: str, text_column: str, least: float = 0.2) -> DataFrame:
    """Records matched one to one with entries of the same group, by likeness of their words.

    Records choose in order the likeliest entry that is still free, the earliest of equally likely ones; under
    ``least`` none is taken, and the record's entry is null.  Choices depend on those before, so a group (a page)
    is worked through in one task; likeness comes from a join of words first, so only pairs that share a word meet.
    """
    words = lambda df, name: df.select(group, F.col(pos).alias(name), tokens(F.col(text_column)).alias("words"))
    r, e = words(records, "record_pos"), words(entries, "entry_pos")
    one = lambda df: df.select("*", F.explode("words").alias("word"))
    shared = one(r).withColumn("rn", F.size("words")).drop("words").join(one(e).withColumn("en", F.size("words")).drop("words"), [group, "word"])
    likely = shared.groupBy(group, "record_pos", "entry_pos").agg((F.count("*") / (F.first("rn") + F.first("en") - F.count("*"))).alias("likeness")).where(F.col("likeness") >= least)

    def claim(page: pd.DataFrame) -> pd.DataFrame:
        taken, last, out = set(), None, []
        page = page.sort_values(["record_pos", "likeness", "entry_pos"], ascending=[True, False, True])
        for record, entry, likeness in zip(page["record_pos"], page["entry_pos"], page["likeness"]):
            if record != last and entry not in taken:
                taken.add(entry)
                out.append((page[group].iloc[0], record, entry, likeness))
                last = record
        return pd.DataFrame(out, columns=[group, "record_pos", "entry_pos", "likeness"])

    kinds = dict(likely.dtypes)
    chosen = likely.groupBy(group).applyInPandas(claim, f"{group} {kinds[group]}, record_pos {kinds['record_pos']}, entry_pos {kinds['entry_pos']}, likeness double")
    return r.select(group, "record_pos").join(chosen, [group, "record_pos"], "left")


def listing_flags(volumes: DataFrame, listing: DataFrame, first: str = "0021", second: str = "0022") -> DataFrame:
    """For each volume the paths of its two sample pages and the number of its files."""
    pairs = contained(listing, "path", "path", volumes.select("id"), "id")
    page = lambda mark: F.max(F.when(F.contains("path", F.lit(mark)), F.col("path")))
    return volumes.join(pairs.groupBy("id").agg(F.count("*").alias("n_files"), page(first).alias("p1"), page(second).alias("p2")), "id", "left")


def year_mismatch(rows: DataFrame, year: Column, catalog_year: Column) -> DataFrame:
    return rows.where(F.left(text(year), F.lit(4)) != F.left(text(catalog_year), F.lit(4)))
