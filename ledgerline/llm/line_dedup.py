"""Line dedup with two Bloom filters.

1. Each task hashes its documents' lines and keeps two Bloom filters: hashes seen in one document
   and hashes seen in two or more.  Only the bits that are set leave the task, dealt by range
   of the filter; a range's owner joins them bit by bit (twice = both twice filters, or both once filters).
2. The twice-seen filter goes to all tasks.  Its size follows the number of documents up to
   MOST_BITS; when more lines come it says "perhaps" more often, which costs shuffle, not rows.
3. Only suspected lines shuffle, as 128-bit digests: exact counts of documents, and the largest doc_id.

Defined cases: null and empty text is one empty line; a row with null doc_id keeps its lines and
counts for none; rows that share a doc_id are one document when documents are counted, and each loses its own
lines; lines shorter than MIN_CHARS never go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, row_hash, slices, text_only, unused

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of the filter for each document, its smallest and largest size, hashes a line, ranges it is dealt by.
BITS_PER_DOC, LEAST_BITS, MOST_BITS, PROBES, RANGES = 64, 1 << 20, 1 << 29, 2, 64


def key_of(line: bytes) -> bytes | None:
    """The line's key, or None for lines that are too short to count."""
    line = line.strip()  # bytes: exactly \x20 and \x09-\x0D
    if len(line) < MIN_CHARS or not line.isascii() and len(line.decode()) < MIN_CHARS:
        return None
    return line.lower()  # bytes: A-Z only


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places in the filter for each hash."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(PROBES)])


def _line_hashes(text: bytes) -> set[int]:
    return {xxhash.xxh3_64_intdigest(k) for k in map(key_of, text.split(b"\n")) if k is not None}


def twice_seen(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """The filter of hashes seen in two documents, as RANGES bit arrays."""
    width = bits // RANGES

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in slices(batches):
            found = [h for t in as_bytes(batch.column(1)) for h in _line_hashes(t)]
            if not found:
                continue
            hashes, n = np.unique(np.array(found, np.uint64), return_counts=True)
            at = _places(hashes, bits)
            before = (once[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)
            for filter_, which in ((twice, before | (n > 1)), (once, np.ones(len(hashes), bool))):
                p = at[:, which].ravel()
                np.bitwise_or.at(filter_, p >> np.uint64(3), np.left_shift(1, p & np.uint64(7)).astype(np.uint8))
        rows = []
        for r in range(RANGES):
            part = slice(r * width // 8, (r + 1) * width // 8)
            if once[part].any():
                sparse = [np.flatnonzero(np.unpackbits(f[part], bitorder="little")).astype("<u4").tobytes() for f in (once, twice)]
                rows.append({"range": r, "once": sparse[0], "twice": sparse[1]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("range", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def join(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = held.setdefault(r, [np.zeros(width, bool), np.zeros(width, bool)])
                one, two = np.frombuffer(one, "<u4"), np.frombuffer(two, "<u4")
                twice[one[once[one]]] = True
                twice[two] = True
                once[one] = True
        for r, (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "twice": [np.packbits(twice, bitorder="little").tobytes()]})

    rows = docs.where("doc_id is not null").mapInArrow(build, "range int, once binary, twice binary")
    joined = rows.repartition(RANGES, "range").mapInArrow(join, "range int, twice binary")
    out = [np.zeros(width // 8, np.uint8) for _ in range(RANGES)]
    for r in joined.collect():  # at most MOST_BITS / 8 bytes in all
        out[r.range] = np.frombuffer(bytes(r.twice), np.uint8)
    return out


def filter_bits(n_docs: int) -> int:
    return min(max(LEAST_BITS, 1 << (n_docs * BITS_PER_DOC).bit_length()), MOST_BITS)


def suspects(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, row, key digest and line numbers of lines that the filter calls repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(np.concatenate(twice_seen(docs, bits)))

    def run(batches):
        seen = shared.value
        for batch in slices(batches):
            ids, rows, keys, numbers = [], [], [], []
            for doc_id, text, row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                mine: dict[bytes, list[int]] = {}
                for k, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    if key is not None:
                        mine.setdefault(key, []).append(k)
                if mine:
                    at = _places(np.fromiter(map(xxhash.xxh3_64_intdigest, mine), np.uint64, len(mine)), bits)
                    hit = (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)
                    for (key, where), yes in zip(mine.items(), hit):
                        if yes:
                            ids.append(doc_id), rows.append(row), keys.append(xxhash.xxh3_128_digest(key)), numbers.append(where)
            if ids:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows, pa.int64()), "line_key": pa.array(keys, pa.binary()), "line_numbers": pa.array(numbers, pa.list_(pa.int32()))})

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, row long, line_key binary, line_numbers array<int>")


def drops(docs: DataFrame) -> DataFrame:
    """doc_id, row and the numbers of the lines that the row loses."""
    docs = text_only(docs).withColumn("row", row_hash())
    # Both are written: suspects so that lines are hashed once more and not twice, keys so that both sides of the
    # join are plain exchanges, as Spark then splits the rows of a very common line.
    found = cut(suspects(docs, filter_bits(docs.count())))
    keys = cut(
        found.groupBy("line_key", "doc_id").agg(F.lit(1).alias("one")).groupBy("line_key")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= MIN_DOCS).select("line_key", "keeper")
    )
    lost = found.join(keys, "line_key").where("doc_id <> keeper")
    return lost.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("line_numbers"))).alias("lost"))


def _with_lost(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, Column]:
    """The rows, each with the numbers of lines that it loses (null if none) in a column that docs doesn't have."""
    lost, doc, row = (unused(docs, n) for n in ("__lost", "__lost_of", "__lost_row"))
    found = drops(docs).select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("lost").alias(lost))
    return rows.join(found, (F.col("doc_id").cast("long") == F.col(doc)) & (row_hash() == F.col(row)), "left"), F.col(lost)


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)


def _kept(lost: Column) -> Column:
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(_lines()) - 1), lost), lambda k: F.get(_lines(), k))
    return F.when(lost.isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; all columns stay."""
    rows, lost = _with_lost(docs, docs)
    return rows.withColumn("text", _kept(lost)).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, lines before, lines dropped, and the hash of what is kept."""
    rows, lost = _with_lost(text_only(docs), docs)
    return rows.select(
        "doc_id", F.size(_lines()).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_kept(lost), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT doc_id, line, n, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
keys AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (WHERE keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN keys USING (k) GROUP BY doc_id
"""
