"""Removal of long byte strings that occur earlier in the corpus.

The method is interval expansion on a Burrows-Wheeler transform, bounded by the minimum length: starting
with the interval of the empty string, all intervals of strings of length l are extended backward by
each byte to those of length l + 1; a border that appears then has a common prefix of exactly l bytes.
So common prefixes come by increasing value, and when l reaches MIN_LENGTH, borders that have not
appeared separate nothing: positions between two known borders share MIN_LENGTH bytes.

A transform of the whole corpus doesn't fit a task, so text that may repeat is brought together first:

1. Anchors.  Each string of 100 bytes belongs to the GRAM bytes of least hash in it (its minimizer),
   so equal strings belong to equal anchors, at the same place.  Anchors shuffle as hashes, with a hash
   of their context: the run of strings of 100 bytes that belong to them.  Equal contexts
   are one class, of which the first stands for all; those after it repeat it whole.  A task joins
   equal contexts before the shuffle, so a passage that a third of all documents share makes one row a task.
2. Anchors with several distinct contexts: those contexts are cut from their documents and gathered by
   anchor, and each group of CHUNK contexts (up to MOST if one anchor has them) is one transform.
3. An anchor with more contexts goes another exact way: its contexts' strings of
   100 bytes are dealt by their own hashes.

Defined cases: null and empty text has no bytes; texts under MIN_LENGTH bytes lose nothing; a null
doc_id is earlier than nothing: such rows keep all; rows that share a doc_id are one document at the
same places: none of two equal strings at the same place is earlier, and each row is reported with its own
text; ties (equal strings in one document) go to the earlier start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, mixed, partitions, slices, text_only

MIN_LENGTH = 100
GRAM = 32
#: Starts of grams in MIN_LENGTH bytes; bytes of context on each side of an anchor.
WINDOW = MIN_LENGTH - GRAM + 1
SIDE = MIN_LENGTH - GRAM
#: Contexts in one transform, and those of one anchor beyond which its strings are dealt by hash; bytes of text
#: that are hashed at once, longer texts in pieces; anchors a task holds before it sends them; bytes of text for
#: each bucket of anchors.
CHUNK, MOST, BATCH, HELD, BUCKET = 4096, 8192, 1 << 19, 1 << 19, 8 << 20
#: Low bits of a gram's hash that give way to its place: the same number everywhere, so that equal strings
#: find equal anchors.  2 * (BATCH + MIN_LENGTH) places are within them.
LOW = np.uint64((1 << 21) - 1)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
#: gram: what the bucket doesn't tell of its hash; doc and row (a hash of the text): whose it is.
_ANCHOR = np.dtype([("gram", "<u4"), ("row", "<u4"), ("context", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])


# ---------------------------------------------------------------- the transform


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Positions of ``text`` (integers under 257) in order of at least ``length`` symbols from there.

    Prefix doubling (or tripling) that starts with seven symbols at once.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 257 + padded[k : k + n]
    done, parts = 7, 3 if n < 1 << 20 else 2  # ranks in one 63-bit key
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if done >= length or rank[order[-1]] == n - 1:
            return order
        key = rank.copy()
        for k in range(1, parts):
            key *= n + 1
            key[: max(n - k * done, 0)] += rank[k * done :] + 1
        done *= parts


def borders(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each of its places whether the common prefix with the place before is under ``length``.

    Breadth-first: ``lo`` and ``hi`` are the intervals of one string length that got a new border.
    """
    n = len(text)
    order = suffix_order(text, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]  # backward extension: where the suffix one longer stands (the text's end wraps)
    symbol = text[order].astype(np.int32)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    came = np.empty(n, np.int64)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        widths = hi - lo
        source = np.repeat(np.arange(len(lo)), widths)
        inside = np.arange(len(source)) - np.repeat(np.cumsum(widths) - widths, widths) + lo[source]
        to = step[inside]
        wrap = order[inside] != 0
        to, source = to[wrap], source[wrap]
        if len(to) * 16 < n:
            by = np.argsort(to)
            to, source = to[by], source[by]
        else:
            came[to] = source
            hit = np.zeros(n, bool)
            hit[to] = True
            to = np.flatnonzero(hit)
            source = came[to]
        # An interval of the longer string: places from one interval with one extending symbol.
        new = np.ones(len(to), bool)
        new[1:] = (source[1:] != source[:-1]) | (symbol[to[1:]] != symbol[to[:-1]])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(to))
        a, z = to[starts], to[ends - 1] + 1 if len(to) else to
        fresh = ~known[z] | ~known[a]
        known[a] = known[z] = True
        lo, hi = a[fresh], z[fresh]
    return order, known[:n]


def repeats(contexts: list[bytes], starts: np.ndarray, length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Context and place of each string of ``length`` bytes that also starts at an earlier place.

    starts: each context's place in one numbering of all bytes of the corpus.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes + 1)
    text = np.zeros(ends[-1], np.uint16)
    keep = np.ones(len(text), bool)
    keep[ends - 1] = False
    text[keep] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    begin = ends - sizes - 1
    where = np.repeat(starts - begin, sizes + 1) + np.arange(len(text))
    room = np.repeat(ends - 1, sizes + 1) - np.arange(len(text))
    order, border = borders(text, length)
    valid = room[order] >= length
    group = np.cumsum(border)[valid]
    if not len(group):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = order[valid]
    at = where[order]
    first = np.minimum.reduceat(at, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
    new = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    hit = at > first[new]
    return np.searchsorted(ends, order[hit], "right"), at[hit]


def repeated(contexts: list[bytes], starts: np.ndarray, length: int = MIN_LENGTH) -> np.ndarray:
    """Ascending starts of strings of ``length`` bytes that also start earlier."""
    return np.unique(repeats(contexts, starts, length)[1])


# ---------------------------------------------------------------- anchors


def _grams(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of ``size`` (a power of two) values from each place; the last places are short."""
    h, n = values.copy(), 1
    while n < size:
        h[: len(h) - n] = h[: len(h) - n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of ``width`` values from each place; the last places are short."""
    out, n = x.copy(), 1
    while 2 * n <= width:
        out[: len(out) - n] = pick(out[: len(out) - n], out[n:])
        n *= 2
    if n < width:
        d = width - n
        out[: len(out) - d] = pick(out[: len(out) - d], out[d:])
    return out


def anchors(pieces: list[bytes], ids: list[int], rows: list[int], offsets: list[int]) -> np.ndarray:
    """The anchors of pieces of at least MIN_LENGTH bytes, 2 * (BATCH + MIN_LENGTH) bytes at most together.

    ids, rows, offsets: each piece's document, its row, and where in it the piece starts.  ``gram`` has 64 bits here.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    n = len(raw)
    gram = _grams(_BYTE[raw], GRAM)
    # A window's least value says where it is; ties go left.
    least = _sliding(mixed(gram) & ~LOW | np.arange(n, dtype=np.uint64), WINDOW, np.minimum)
    ends = begin + sizes - MIN_LENGTH + 1
    valid = np.ones(n, bool)
    for b, e in zip(ends.tolist(), (begin + sizes).tolist()):
        valid[b:e] = False
    window = np.flatnonzero(valid)
    at = (least[window] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    at, left, right = at[first], at[first] - window[first], window[last] + MIN_LENGTH - GRAM - at[first]
    piece = np.searchsorted(begin, at, "right") - 1
    context = mixed((left * 256 + right).astype(np.uint64))
    for k in range(0, 2 * SIDE + GRAM, GRAM):  # grams that cover the context; at + right is where its last one starts
        context = mixed(context) + gram[np.minimum(at - left + k, at + right)]
    out = np.empty(len(at), _FOUND)
    out["gram"], out["context"], out["doc"], out["row"] = mixed(gram[at]), mixed(context), np.asarray(ids, np.int64)[piece], np.asarray(rows, np.uint32)[piece]
    out["at"], out["left"], out["right"] = at - begin[piece] + np.asarray(offsets, np.int64)[piece], left, right
    return out


_FOUND = np.dtype([("gram", "<u8")] + [(n, _ANCHOR[n]) for n in _ANCHOR.names if n != "gram"])


def _later(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors, equal grams together and in order of context and place; and which repeat the context of an earlier place.

    An anchor that comes twice (repeated rows) is one.
    """
    by = np.argsort(a["gram"])
    equal = a["gram"][by]
    equal = equal[1:] == equal[:-1]
    many = np.zeros(len(a), bool)
    many[by[1:][equal]] = True
    many[by[:-1][equal]] = True
    sub = a[many]
    sub = sub[np.lexsort((sub["row"], sub["at"], sub["doc"], sub["context"], sub["gram"]))]
    sub, again = _repeats(sub, ("gram", "context"))
    return np.concatenate([sub, a[~many]]), np.concatenate([again, np.zeros(len(a) - many.sum(), bool)])


def _repeats(x: np.ndarray, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of keys, doc, at and row, each once; and which have an earlier place than theirs before them under their keys."""
    same = np.ones(max(len(x) - 1, 0), bool)
    for k in keys:
        same &= x[k][1:] == x[k][:-1]
    twice = same.copy()
    for k in ("doc", "at", "row"):
        twice &= x[k][1:] == x[k][:-1]
    once = np.concatenate([np.ones(min(len(x), 1), bool), ~twice])
    group = np.concatenate([np.zeros(min(len(x), 1), bool), same])
    first = np.maximum.accumulate(np.where(group, 0, np.arange(len(x))))
    again = group & ((x["doc"] != x["doc"][first]) | (x["at"] != x["at"][first]))
    return x[once], again[once]


def _joined(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans in order of their start, those that meet or overlap as one."""
    end = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], axis=1)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]) - 1, bool)
    for x in keys:
        new |= x[1:] != x[:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    return list(zip(first.tolist(), np.append(first[1:], len(keys[0])).tolist()))


#: key and row: a document and one of its rows, or a bucket and nothing.
_ROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("data", pa.binary())])
_SCHEMA = "kind int, key long, row long, data binary"
SPANS, ANCHORS, WANTED, HOT = 0, 1, 2, 3


def _sent(rows: list[tuple]):
    """Rows (kind, key, row, data) as batches."""
    for k in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000]), _ROW.types)], schema=_ROW)


def _spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """Joined spans of each row of each document."""
    by = np.lexsort((start, row, doc))
    doc, row, start, end = doc[by], row[by], start[by], end[by]
    return [(SPANS, int(doc[k]), int(row[k]), _joined(start[k:z], end[k:z]).astype("<u4").tobytes()) for k, z in _runs(doc, row)]


def _whole(a: np.ndarray) -> list[tuple]:
    """Anchors whose context repeats: all of the context goes."""
    return _spans(a["doc"], a["row"], a["at"] - a["left"].astype(np.int64), a["at"].astype(np.int64) + GRAM + a["right"])


def _by_bucket(bucket: np.ndarray, x: np.ndarray) -> list[tuple]:
    by = np.argsort(bucket, kind="stable")
    bucket, x = bucket[by], x[by]
    return [(ANCHORS, int(bucket[k]), 0, x[k:z].tobytes()) for k, z in _runs(bucket)]


def _pieces(batches):
    """Lists of (piece, doc, row, offset) of BATCH bytes or a little more; each string of a text is in one piece."""
    part, weight = [], 0
    for batch in slices(batches):
        for text, doc, row in zip(as_bytes(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            for at in range(0, len(text) - MIN_LENGTH + 1, BATCH):
                part.append((text[at : at + BATCH + MIN_LENGTH - 1], doc, row, at))
                weight += len(part[-1][0])
                if weight >= BATCH:
                    yield part
                    part, weight = [], 0
    if part:
        yield part


def _find_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def send(held):
        a, again = _later(np.concatenate(held))
        first = a[~again]
        bucket = (first["gram"] >> np.uint64(32)) % np.uint64(buckets)
        yield from _sent(_by_bucket(bucket, first.astype(_ANCHOR)))
        yield from _sent(_whole(a[again]))

    def run(batches):
        held, n = [], 0
        for part in _pieces(batches):
            held.append(anchors(*zip(*part)))
            n += len(held[-1])
            if n >= HELD:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    return docs.mapInArrow(run, _SCHEMA)


def _each_key(batches, work):
    """Feed the data of rows that follow each other with the same key to ``work``; spans, which are final, go along."""
    key, held = None, []
    for batch in batches:
        spans = pc.equal(batch.column(0), SPANS)
        yield batch.filter(spans)
        batch = batch.filter(pc.invert(spans))
        for k, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if k != key and held:
                yield from work(key, held)
                held = []
            key = k
            held.append(data)
    if held:
        yield from work(key, held)


def _compare(rows: DataFrame) -> DataFrame:
    """Spans of repeated contexts; and by document the anchors whose context is to be compared, or is of too many."""

    def work(bucket, held):
        a, again = _later(np.concatenate([np.frombuffer(x, _ANCHOR) for x in held]))
        yield from _sent(_whole(a[again]))
        first = a[~again]
        start, end = np.array(_runs(first["gram"]), np.int64).T
        n = np.repeat(end - start, end - start)
        for kind, which in ((WANTED, (n > 1) & (n <= MOST)), (HOT, n > MOST)):
            f = first[which]
            f = f[np.lexsort((f["at"], f["row"], f["doc"]))]
            wanted = np.empty(len(f), _WANT)
            for name in ("at", "left", "right"):
                wanted[name] = f[name]
            wanted["gram"] = np.uint64(bucket) << np.uint64(32) | f["gram"].astype(np.uint64)
            yield from _sent([(kind, int(f["doc"][k]), int(f["row"][k]), wanted[k:z].tobytes()) for k, z in _runs(f["doc"], f["row"])])

    return _dealt(rows).mapInArrow(lambda batches: _each_key(batches, work), _SCHEMA)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in order of kind and key; spans, which are final, go along so that nothing has to be made twice."""
    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key").select("kind", "key", "row", "data")


#: gram: bucket and gram.
_WANT = np.dtype([("gram", "<u8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])
_CONTEXT = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, doc_id, row, start and bytes of wanted contexts."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for doc, text, row, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                w = np.frombuffer(data, _WANT)
                start = w["at"].astype(np.int64) - w["left"]
                end = w["at"].astype(np.int64) + GRAM + w["right"]
                out += [(g, doc, row, a, text[a:z]) for g, a, z in zip(w["gram"].view("<i8").tolist(), start.tolist(), end.tolist())]
                if len(out) > 20_000:
                    yield contexts(out)
                    out = []
            if out:
                yield contexts(out)

    def contexts(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CONTEXT.types)], schema=_CONTEXT)

    joined = _named(docs).join(wanted.select(F.col("key").alias("doc_id"), "row", "data"), ["doc_id", "row"])
    return joined.select("doc_id", "text", "row", "data").mapInArrow(run, "gram long, doc_id long, row long, start long, bytes binary")


def _named(docs: DataFrame) -> DataFrame:
    """The rows dealt by document and row, once for whatever joins them."""
    return docs.repartition(partitions(docs), "doc_id", "row")


def _strings(doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> list[tuple]:
    return _spans(doc, row, at, at + MIN_LENGTH)


def _transforms(contexts: DataFrame) -> DataFrame:
    """Spans from transforms of at most CHUNK contexts (up to MOST if one anchor has them)."""

    def work(rows):
        doc, row, start = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        ids, index = np.unique(doc, return_inverse=True)
        which, at = repeats([r[4] for r in rows], (index << 32) + start)
        yield from _sent(_strings(doc[which], row[which], at & 0xFFFFFFFF))

    def run(batches):
        held, group = [], []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    if len(held) + len(group) > CHUNK and held:
                        yield from work(held)
                        held = []
                    held += group
                    group = []
                group.append(row)
        if held and len(held) + len(group) > CHUNK:
            yield from work(held)
            held = []
        if held or group:
            yield from work(held + group)

    dealt = contexts.select("gram", "doc_id", "row", "start", "bytes").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, _SCHEMA)


def _by_strings(contexts: DataFrame, buckets: int) -> DataFrame:
    """Spans from contexts of very frequent anchors: their strings meet by hash, the first of each task only."""
    kind = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("row", "<u4")])

    def found(x):
        """Strings that are to be compared further, and spans of those that repeat an earlier one."""
        x, again = _repeats(x[np.lexsort((x["row"], x["at"], x["doc"], x["hash"]))], ("hash",))
        r = x[again]
        return x[~again], _strings(r["doc"], r["row"], r["at"].astype(np.int64))

    def send(held):
        x, out = found(np.concatenate(held))
        yield from _sent(out + _by_bucket((x["hash"] >> np.uint64(16)) % np.uint64(buckets), x))

    def run(batches):
        held, n = [], 0
        for batch in slices(batches):
            for doc, row, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                v = _BYTE[np.frombuffer(data, np.uint8)]
                h64 = _grams(v, 64)
                h32 = _grams(v, 32)
                m = len(v) - MIN_LENGTH + 1
                h = mixed(mixed(h64[:m]) + mixed(h32[64 : 64 + m]) * np.uint64(3) + h32[MIN_LENGTH - 32 : MIN_LENGTH - 32 + m])
                x = np.empty(m, kind)
                x["hash"], x["doc"], x["at"], x["row"] = h, doc, start + np.arange(m), row
                held.append(x)
                n += m
            if n >= HELD:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    def meet(_, held):
        yield from _sent(found(np.concatenate([np.frombuffer(b, kind) for b in held]))[1])

    return _dealt(contexts.select("doc_id", "row", "start", "bytes").mapInArrow(run, _SCHEMA)).mapInArrow(lambda batches: _each_key(batches, meet), _SCHEMA)


# ---------------------------------------------------------------- the operator


def _rows_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, and 32 bits of the text that tell rows of one doc_id apart."""
    return text_only(docs, *more).withColumn("row", F.hash("text").cast("long").bitwiseAND(0xFFFFFFFF))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, row and ``spans``: arrays of packed (start, end) pairs of bytes to remove, not yet joined."""
    docs = _rows_of(docs).where("doc_id is not null")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(docs), n_bytes // BUCKET)
    compared = cut(_compare(_find_anchors(docs, buckets)))
    every = compared.where(F.col("kind") == SPANS).unionByName(_transforms(_cut_out(docs, compared.where(F.col("kind") == WANTED))))
    hot = compared.where(F.col("kind") == HOT)
    if not hot.isEmpty():
        every = every.unionByName(_by_strings(_cut_out(docs, hot), buckets))
    return every.groupBy(F.col("key").alias("doc_id"), "row").agg(F.collect_list("data").alias("spans"))


def _kept(text: bytes, packed: list[bytes] | None) -> tuple[bytes, int, int]:
    """The rest of a text, bytes removed, and removed runs."""
    if not packed:
        return text, 0, 0
    s = np.concatenate([np.frombuffer(p, "<u4").reshape(-1, 2) for p in packed]).astype(np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    out, at, gone = [], 0, _joined(s[:, 0], s[:, 1])
    for a, z in gone.tolist():
        out.append(text[at:a])
        at = z
    out.append(text[at:])
    kept = b"".join(out)
    return kept, len(text) - len(kept), len(gone)


def with_spans(docs: DataFrame, *more: str) -> DataFrame:
    d = _rows_of(docs, *more)
    named = _named(d.where("doc_id is not null")).join(spans(docs), ["doc_id", "row"], "left").drop("row")
    return named.unionByName(d.where("doc_id is null").drop("row").withColumn("spans", F.lit(None).cast("array<binary>")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, bytes and runs removed, and the hash of what is kept."""

    def run(batches):
        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            kept = [_kept(t, p) for t, p in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "n_removed": [n for _, n, _ in kept],
                "n_spans": [n for _, _, n in kept], "kept_sha256": [hashlib.sha256(t).hexdigest() for t, _, _ in kept],
            })

    return with_spans(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id and the rest of each text, as bytes: a cut may fall inside a character."""

    def run(batches):
        for batch in slices(batches):
            kept = [_kept(t, p)[0] for t, p in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "kept": pa.array(kept, pa.binary())})

    return with_spans(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary")
