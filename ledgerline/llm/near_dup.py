"""Near-duplicate documents: circulant MinHash, banding, exact verification.

Signature.  A set's 64-bit shingle hashes are brought to the 32-bit circle by one permutation;
coordinate k is the least value of a second permutation on the circle, shifted by k steps.  So two
permutations make all coordinates (circulant MinHash).

Candidates.  Bands of a few coordinates each.  A pair of sets at the threshold shares no band with a
chance of about one in a million: (1 - 0.85^7)^36 for QUERY, (1 - 0.8^6)^46 for STAGE.

Work is on classes (distinct sets), so exact copies cost nothing beyond one aggregation:

1. Buckets of two and more classes.  A bucket's pivot is its member that shares most buckets with
   others: an original rather than one of its edited copies.  Each class is compared with its best
   pivot only, so a bucket makes as many pairs as it has members.
2. Links so found make components.  Where a bucket still holds several components, its members of
   different components are compared by their signatures, in blocks of BLOCK, and pairs are kept whose
   estimate allows the threshold (5 deviations); each pair in the first band whose bucket both are in.
3. The sets of those classes go to the tasks that hold their pairs.  A pair is verified on full sets
   unless links before it have joined its components: so a task makes fewer links than it has members.

Defined cases: null or empty text, or text without words, has no shingles, is linked with nothing and
kept; a null doc_id is linked with nothing, its component is null and it is kept; rows that share a
doc_id are all reported, each with its own text's component; of a component ``keep_first`` keeps one row, that of
least doc_id and then of least hash of the text, so texts under one doc_id that aren't linked stay each; of rows
without shingles it keeps one for each doc_id and text; ties go to the least doc_id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from .common import Seen, alone, as_bytes, cut, forgets, mixed, row_hash, slices, text_only, unused

SHINGLE = 5


class Contract(NamedTuple):
    """What is a link, and the bands that find them: link if link[1] * intersection >= link[0] * union."""

    link: tuple[int, int]
    bands: int
    rows: int

    @property
    def coords(self) -> int:
        return self.bands * self.rows

    @property
    def estimate(self) -> float:
        """The least estimate of a pair that may be a link: estimates from all coordinates may deviate five times."""
        at = self.link[0] / self.link[1]
        return at - 5 * (at * (1 - at) / self.coords) ** 0.5


#: The op2 query links at 0.85, the pipeline's stage at 0.8.
QUERY, STAGE = Contract((85, 100), 36, 7), Contract((80, 100), 46, 6)
COORDS = QUERY.coords
#: Classes of a block, and shingles (about) of all its sets; shingles that are hashed at once.
BLOCK, WEIGHT = 512, 1 << 20
CHUNK = 1 << 15
_STEP = 0x9E3779B9
_HASH = Seen(lambda w: xxhash.xxh3_64_intdigest(w), 300_000)
forgets(__name__, _HASH.clear)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = mixed(out) + h[i : n - k + 1 + i]
    return np.unique(mixed(out) + np.uint64(k))


def signatures(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Circulant coordinates of each set; none may be empty."""
    out = np.empty((len(sets), coords), np.uint32)
    at = 0
    while at < len(sets):
        part, weight = [], 0
        while at < len(sets) and (not part or weight + len(sets[at]) <= CHUNK):
            part.append(sets[at])
            weight += len(sets[at])
            at += 1
        x = (mixed(np.concatenate(part)) >> np.uint64(32)).astype(np.uint32)  # the first permutation
        starts = np.cumsum([0] + [len(s) for s in part[:-1]])
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(coords):
            np.add(x, np.uint32(k * _STEP & 0xFFFFFFFF), out=y)  # the shift
            y *= np.uint32(0x7FEB352D)  # the second permutation
            np.right_shift(y, np.uint32(15), out=z)
            y ^= z
            y *= np.uint32(0x846CA68B)
            np.right_shift(y, np.uint32(16), out=z)
            y ^= z
            out[at - len(part) : at, k] = np.minimum.reduceat(y, starts)
    return out


def signed(docs: DataFrame, how: Contract = QUERY) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, cls (hash of the set), bands (hashes) and sketch (a byte of each coordinate)."""

    def run(batches):
        alone(__name__)
        for batch in slices(batches):
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingles(t) for t in as_bytes(part.column(1))]
                cls, bands, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    sig = signatures([sets[k] for k in full], how.coords)
                    b = np.zeros((len(full), how.bands), np.uint64) + np.arange(how.bands, dtype=np.uint64)
                    for r in range(how.rows):
                        b = mixed(b) + sig.reshape(-1, how.bands, how.rows)[:, :, r]
                    b = mixed(b).view(np.int64)
                    low = sig.astype(np.uint8)
                    for j, k in enumerate(full):
                        cls[k], bands[k], sketch[k] = xxhash.xxh3_64_intdigest(sets[k].tobytes()) - (1 << 63), b[j], low[j].tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                ], ["doc_id", "row", "n_shingles", "cls", "bands", "sketch"])

    return text_only(docs).withColumn("row", row_hash()).mapInArrow(run, "doc_id long, row long, n_shingles long, cls long, bands array<long>, sketch binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from sketches, without chance agreement of bytes."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sizes_allow(a, b, link: tuple[int, int]):
    return link[1] * np.minimum(a, b) >= link[0] * np.maximum(a, b)


def _estimated(pairs: DataFrame, sketches: DataFrame, how: Contract = QUERY) -> DataFrame:
    """a, b and the estimate of pairs that may be links."""
    s = lambda x: sketches.select(F.col("cls").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("n_shingles").alias(f"{x}_n"))
    rows = pairs.select("a", "b").join(s("a"), "a").join(s("b"), "b").where(how.link[1] * F.least("a_n", "b_n") >= how.link[0] * F.greatest("a_n", "b_n"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, how.coords) for k in (2, 3))
                e = _agree(x, y)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(e)], ["a", "b", "estimate"])
                yield out.filter(pa.array(e >= how.estimate))

    return rows.select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long, estimate double")


def _grouped(batches, work):
    """Feed rows that follow each other with the same first value to ``work``; it yields record batches."""
    alone(__name__)
    key, rows = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if rows:
                    yield from work(key, rows)
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield from work(key, rows)


_PAIRS = pa.schema([("task", pa.int64()), ("cls", pa.int64()), ("comp", pa.int64()), ("partners", pa.binary())])


def _packed(bands: Column) -> Column:
    """The hashes of a class's bands as one binary, 8 bytes each."""
    return F.unhex(F.array_join(F.transform(bands, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _within(blocks: DataFrame, how: Contract = QUERY) -> DataFrame:
    """Pairs of classes of different components in one bucket whose sketches allow a link.

    blocks: task (a bucket's pair of blocks), band, cls, comp, n_shingles, sketch, keys (the bands' hashes, packed),
    block; sorted by task within each partition.  Returns a row for each class that has a pair: task, cls, comp and
    ``partners``, the classes after it that it is to be compared with (packed, may be none).
    """

    def work(task, rows):
        band, cls, comp, n, sketch, keys, block = zip(*rows)
        cls, comp, n, block = (np.array(x) for x in (cls, comp, n, block))
        sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, how.coords)
        keys = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, how.bands)
        one = block.min() == block.max()
        left = np.flatnonzero(block == block.min())
        right = left if one else np.flatnonzero(block == block.max())
        partners, needed = {}, set()
        for i in left:
            j = right[right > i] if one else right
            j = j[(comp[j] != comp[i]) & _sizes_allow(n[j], n[i], how.link)]
            if not len(j):
                continue
            j = j[_agree(sketch[j], sketch[i]) >= how.estimate]
            # By the hashes that made the buckets: sketches may agree in a band that isn't shared.
            j = j[(keys[j] == keys[i]).argmax(axis=1) == band[0]]
            if len(j):
                partners[i] = cls[j].astype("<i8").tobytes()
                needed |= {i, *j.tolist()}
        if needed:
            k = sorted(needed)
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(k), pa.int64()), pa.array(cls[k]), pa.array(comp[k]), pa.array([partners.get(i, b"") for i in k], pa.binary())], schema=_PAIRS)

    return blocks.mapInArrow(lambda batches: _grouped(batches, work), "task long, cls long, comp long, partners binary")


def _is_link(x: np.ndarray, y: np.ndarray, link: tuple[int, int]) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return link[1] * both >= link[0] * (len(x) + len(y) - both)


def _settled(pairs: DataFrame, sets: DataFrame, how: Contract = QUERY) -> DataFrame:
    """Links a, b between components, enough of each task's to connect all that its pairs connect.

    Every pair is verified on full sets unless links before it have joined its components.
    """

    def work(task, rows):
        members = {cls: np.frombuffer(m, np.uint64) for cls, _, _, m in rows}
        comps = {cls: comp for cls, comp, _, _ in rows}
        root: dict[int, int] = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        links = []
        for cls, comp, partners, _ in rows:
            for other in np.frombuffer(partners, "<i8").tolist():
                x, y = find(comp), find(comps[other])
                if x != y and _is_link(members[cls], members[other], how.link):
                    root[x] = y
                    links.append((comp, comps[other]))
        if links:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]})

    rows = pairs.join(sets, "cls").select("task", "cls", "comp", "partners", "members")
    return rows.repartition("task").sortWithinPartitions("task", "cls").mapInArrow(lambda batches: _grouped(batches, work), "a long, b long")


def _sets(classes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and members (packed shingle hashes) of classes.  reps: cls and rep, a doc_id that has the set."""
    # A doc_id may come with several texts; the class says which one is meant.
    texts = text_only(docs).join(classes.select("cls").distinct().join(reps, "cls").select(F.col("rep").alias("doc_id"), "cls"), "doc_id")

    def load(batches):
        alone(__name__)
        for batch in slices(batches):
            seen = [(c, s.tobytes()) for c, s in ((c, shingles(t)) for t, c in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist())) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == c]
            if seen:
                yield pa.RecordBatch.from_pydict({"cls": pa.array([c for c, _ in seen], pa.int64()), "members": pa.array([m for _, m in seen], pa.binary())})

    return cut(texts.select("text", "cls").mapInArrow(load, "cls long, members binary").dropDuplicates(["cls"]))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, how: Contract = QUERY) -> DataFrame:
    """The pairs a, b of classes that are links."""
    pairs = cut(pairs)
    sets = _sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))), reps, docs)
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("members").alias(f"{x}_members"))

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                yes = [_is_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), how.link) for x, y in zip(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "a_members", "b_members").mapInArrow(test, "a long, b long")


def linked(docs: DataFrame, sigs: DataFrame, how: Contract = QUERY) -> tuple[DataFrame, DataFrame | None]:
    """node, label of classes with a link to their pivot; and labels of those labels that further links join."""
    named = sigs.where("cls is not null and doc_id is not null")
    classes = cut(named.select("cls", "n_shingles", "bands", "sketch").dropDuplicates(["cls"]))
    reps = cut(named.groupBy("cls").agg(F.min("doc_id").alias("rep")))
    members = classes.select("cls", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(crowded, "bucket"))
    central = members.groupBy("cls").agg(F.sum("n").alias("central"))
    pivots = members.join(central, "cls").groupBy("bucket").agg(F.max(F.struct("central", "cls")).alias("pivot"))
    star = members.join(pivots, "bucket").select(F.col("cls").alias("a"), F.col("pivot.cls").alias("b")).where("a <> b").distinct()
    best = _estimated(star, classes, how).groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("best"))
    # A pivot comes after its class in the order of (central, cls), so these links make trees.
    labels = components.climb(_verified(best.select("a", F.col("best.b").alias("b")), reps, docs, how))
    # What shares a bucket and isn't in one component yet.
    rest = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "band", "cls", "n_shingles", F.coalesce("label", "cls").alias("comp"))
    sizes = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / WEIGHT)).cast("int")
    mixed_up = rest.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), sizes.alias("blocks")).where("x <> y").select("bucket", "blocks")
    rest = rest.drop("n_shingles").join(mixed_up, "bucket")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("task", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    rest = rest.join(classes.select("cls", "n_shingles", "sketch", _packed(F.col("bands")).alias("keys")), "cls").select("task", "band", "cls", "comp", "n_shingles", "sketch", "keys", "block")
    pairs = cut(_within(rest.repartition("task").sortWithinPartitions("task", "cls"), how))
    if pairs.isEmpty():
        return labels, None
    more = cut(_settled(pairs, _sets(pairs, reps, docs), how))
    return labels, None if more.isEmpty() else components.label(more)


def _components(docs: DataFrame, how: Contract) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, row, n_shingles, cls of every document; cls and comp of every class; comp and least (doc_id, row) of every component."""
    sigs = cut(signed(docs, how))
    labels, further = linked(docs, sigs, how)
    ids = sigs.select("doc_id", "row", "n_shingles", "cls")
    reps = ids.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    comps = reps.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("label", "cls").alias("comp"))
    if further is not None:
        comps = comps.join(further.withColumnRenamed("node", "comp"), "comp", "left").select("cls", "rep", F.coalesce("label", "comp").alias("comp"))
    return ids, comps.select("cls", "comp"), comps.groupBy("comp").agg(F.min("rep").alias("least"))


def near_duplicates(docs: DataFrame, how: Contract = QUERY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    ids, comps, least = _components(docs, how)
    of_class = comps.join(least, "comp").select("cls", F.col("least.doc_id").alias("component"))
    out = ids.join(of_class, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, how: Contract = QUERY) -> DataFrame:
    """One row of each component, with its columns; rows without doc_id stay."""
    ids, _, least = _components(docs, how)
    doc, row = unused(docs, "__doc"), unused(docs, "__row")
    bare = ids.where("cls is null and doc_id is not null").select("doc_id", "row")
    kept = least.select("least.*").unionByName(bare).toDF(doc, row)
    named = docs.where("doc_id is not null").withColumns({doc: F.col("doc_id").cast("long"), row: row_hash()})
    return named.join(kept, [doc, row], "left_semi").dropDuplicates([doc, row]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
