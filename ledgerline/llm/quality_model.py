"""Quality classifier: gradient-boosted trees on histograms of document statistics.

The trees are trained with numpy on the driver, on a bounded sample of labelled rows
(``sample`` rows, those of least id hash), and kept as flat arrays that numpy walks level by level
for a whole batch of documents.

Defined cases: null and empty text has statistics of zero and gets a score like any other;
documents without label are scored only; a doc_id labelled more than once counts with its least
label; labels that are null are ignored; if all labels are one, every score is that label, and without labels
0.5; repeated rows get equal scores and, like rows that share a doc_id, are one row (of least statistics) in the
sample; null doc_id is never in the held-out part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, as_bytes, map_rows, slices, text_only

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, DECAY = 80, 4, 0.12, 48, 8, 1.0
KEEP_FROM = 0.3

_CLASSES = {
    "space": b" ", "newline": b"\n", "digit": b"0123456789", "stop": b".!?", "comma": b",;:", "symbol": b"#*$%&|<>@{}[]\\/=+~^_`",
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "vowel": b"aeiouAEIOU", "quote": b"\"'()-", "high": bytes(range(128, 256)),
}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars), _k] = 1
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_spread", "long_words", "short_words", "distinct_words", "log_distinct", "top_word", "repeat_pairs",
    "log_lines", "line_length", "distinct_lines", "blank_lines", "byte_entropy", "top_byte", *(f"{x}_share" for x in _CLASSES),
]


def statistics(text: bytes) -> list[float]:
    """FEATURES of one text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts / n
    held = shares[shares > 0]
    words = text.split()
    n_words = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = text.split(b"\n")
    return [
        np.log1p(n), np.log1p(n_words),
        *((lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths < 3).mean(), len(tally) / n_words) if n_words else (0.0,) * 5),
        np.log1p(len(tally)), max(tally.values()) / n_words if n_words else 0.0,
        1 - len(set(zip(words, words[1:]))) / (n_words - 1) if n_words > 1 else 0.0,
        np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines), sum(not x for x in lines) / len(lines),
        -(held * np.log2(held)).sum(), shares.max(), *(shares @ _CLASS),
    ]


@dataclass
class Trees:
    """Complete trees of DEPTH levels: node k has children 2k+1 and 2k+2; ``cut`` is in feature units."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost on log loss; the gain of each bin border comes from one histogram a feature and level."""
    n, m = x.shape if len(x) else (0, len(FEATURES))
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = y.mean() if n else 0.5
    base = float(np.log(share / (1 - share))) if 0 < share < 1 else (np.inf if share == 1 else -np.inf)
    if not n or share in (0, 1):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(borders[f], x[:, f], "left") for f in range(m)], axis=1)  # x > border k  <=>  bin > k
    margin = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = node - first
            best = np.full(width, 1e-9)
            where = np.full((width, 2), -1)
            for f in range(m):
                key = at * BINS + binned[:, f]
                g, h, c = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (grad, hess, None))
                gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
                gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
                gain = gl**2 / (hl + DECAY) + gr**2 / (hr + DECAY) - g[:, -1:] ** 2 / (h[:, -1:] + DECAY)
                gain[(cl < LEAST) | (cr < LEAST)] = 0
                gain[:, len(borders[f]) :] = 0
                top = gain.argmax(axis=1)
                got = gain[np.arange(width), top]
                better = got > best
                best[better] = got[better]
                where[better] = np.stack([np.full(width, f), top], axis=1)[better]
            for k, (f, b) in enumerate(where):
                if f >= 0:
                    feature[first + k], cut[first + k] = f, borders[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = RATE * g / (h + DECAY)
        margin += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents outside the held-out fold.

    Only labelled rows are read into the sample, so what reaches the driver is bounded by it.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = text_only(docs).join(F.broadcast(ids), "doc_id")

    def make(batch):
        return {"doc_id": batch.column(0), "quality": batch.column(2), "x": pa.array([statistics(t) for t in as_bytes(batch.column(1))], pa.list_(pa.float64()))}

    rows = map_rows(rows.select("doc_id", "text", "quality"), make, "doc_id long, quality int, x array<double>")
    got = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    order = sorted(range(len(got)), key=lambda k: (got.doc_id[k], tuple(got.x[k])))
    x = np.array([got.x[k] for k in order], float).reshape(len(got), len(FEATURES))
    return fit(x, got.quality.to_numpy(float)[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, whatever the corpus

    def make(batch):
        x = np.array([statistics(t) for t in as_bytes(batch.column(1))]).reshape(-1, len(FEATURES))
        s = shared.value.score(x)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= KEEP_FROM).astype(np.int32)}

    rows = text_only(docs, F.coalesce(fold(F.col("doc_id").cast("long")) == 0, F.lit(False)).alias("held_out"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """Documents that the model accepts, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        alone(__name__)
        for batch in slices(batches):
            x = np.array([statistics(t) for t in as_bytes(batch.column(batch.schema.get_field_index("text")))])
            yield batch.filter(pa.array(shared.value.score(x) >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)
