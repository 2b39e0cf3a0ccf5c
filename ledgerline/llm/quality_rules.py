"""Quality rules whose cutoffs are chosen to reject few good documents.

Each rule compares one statistic of a document with a cutoff.  For each rule and stratum (the
language), the cutoffs of a fixed grid are tested from the mildest to the strictest on labelled good
documents: a cutoff is allowed if the exact (Clopper-Pearson) upper bound of its false
rejection rate is at most ``RISK / number of rules``, at confidence ``1 - ERROR`` shared among all
rules and strata (Bonferroni).  Testing along the grid stops at the first cutoff that isn't allowed
(a fixed sequence, which needs no further correction).  The strictest allowed cutoff is used; a rule
without one rejects nothing.  So with probability ``1 - ERROR``, in every stratum at once, at most a
share RISK of good documents is rejected by the rules together.

What is counted for each rule, stratum and cutoff is a sum over all labelled documents, made where
the rows are; only the counts (rules x grid) of strata with enough good documents to show a bound
(``enough``) reach the driver, and the cutoffs go back as a table that is joined.  Every stratum
counts for Bonferroni.

Defined cases: null and empty text has no words and fails the base rule; null or unknown languages
are a stratum of their own; without labelled good documents only the base rule rejects; a doc_id
labelled more than once counts with its least label; repeated rows get equal verdicts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Seen, as_bytes, cut, forgets, map_rows, mixed, text_only

RISK, ERROR = 0.05, 0.05
#: Statistic, and whether a document is rejected above or below the cutoff; from mild to strict.
RULES = {
    "symbol_share": ("above", [0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.035, 0.025, 0.02, 0.015, 0.01, 0.0075, 0.005]),
    "dup_line_share": ("above", [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeat_word_share": ("above", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "word_length_high": ("above", [30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0]),
    "word_length_low": ("below", [1.5, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0]),
}
SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_HASH = Seen(lambda w: xxhash.xxh3_64_intdigest(w), 300_000)
forgets(__name__, _HASH.clear)


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
        w = mixed(mixed(mixed(h[:-2]) + h[1:-1]) + h[2:])
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, len(text.translate(None, _OTHERS)), len(lines) - len(set(lines)), repeated, len(lines)


_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every document, and its language."""

    def make(batch):
        rows = [counts(t) for t in as_bytes(batch.column(1))]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
        return {"doc_id": batch.column(0), "lang": batch.column(2)} | {k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows))}

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return map_rows(text_only(docs, lang.alias("lang")), make, _SCHEMA)


def with_statistics(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    length = share("word_chars", "n_words")
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"), "word_length_high": length, "word_length_low": length,
    })


def _upper_tail(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function of x, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _upper_tail(b, a, 1 - x)
    least = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), least)
    whole = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or least)
            c = 1 + step / c or least
            whole *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return whole / a * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper bound of a rate of which k in n were seen: where P(X <= k) falls to ``error``."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        # P(X <= k) of a binomial is the incomplete beta function of 1 - p.
        lo, hi = (p, hi) if _upper_tail(n - k, k + 1, 1 - p) > error else (lo, p)
    return hi


def _error(strata: int) -> float:
    return ERROR / (len(RULES) * max(strata, 1))


def enough(strata: int) -> int:
    """Good documents without which no cutoff can be allowed, even if it rejects none of them."""
    return math.floor(math.log(_error(strata)) / math.log1p(-RISK / len(RULES)))


def choose(table: dict[str, tuple[int, dict[str, list[int]]]], strata: int | None = None) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule from the number of good documents and how many each cutoff rejects.

    strata: how many there are, if the table leaves out some that can't get a cutoff.
    """
    error = _error(len(table) if strata is None else strata)
    risk = RISK / len(RULES)
    out: dict[str, dict[str, float]] = {}
    for stratum, (n, rejected) in table.items():
        for rule, (_, grid) in RULES.items():
            for cutoff, k in zip(grid, rejected[rule]):
                if k > risk * n or upper_bound(k, n, error) > risk:
                    break
                out.setdefault(stratum, {})[rule] = cutoff
    return out


def _rejects(rule: str, cutoff) -> F.Column:
    return F.col(rule) > cutoff if RULES[rule][0] == "above" else F.col(rule) < cutoff


def fit(rows: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """Cutoffs from every labelled good document that passes the base rule."""
    good = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    )
    sums = [F.count_if(_rejects(rule, cutoff)).alias(f"{rule}_{k}") for rule, (_, grid) in RULES.items() for k, cutoff in enumerate(grid)]
    tallies = rows.join(good.select("doc_id"), "doc_id", "left_semi").where("not base_failed").groupBy(F.coalesce("lang", F.lit("")).alias("stratum")).agg(F.count("*").alias("n"), *sums)
    tallies, table = cut(tallies), {}
    strata = tallies.count()
    for r in tallies.where(F.col("n") >= enough(strata)).collect():
        table[r.stratum] = (r.n, {rule: [r[f"{rule}_{k}"] for k in range(len(grid))] for rule, (_, grid) in RULES.items()})
    return choose(table, strata)


def judge(rows: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """base_failed and kept, and the first rule that rejects."""
    found = [(s, *(c.get(rule) for rule in RULES)) for s, c in cutoffs.items()]
    table = rows.sparkSession.createDataFrame(found, ", ".join(["_stratum string", *(f"_{rule} double" for rule in RULES)]))
    hits = [F.when(_rejects(rule, F.col(f"_{rule}")), F.lit(rule)) for rule in RULES]
    rejected_by = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*hits))
    joined = rows.withColumn("_stratum", F.coalesce("lang", F.lit(""))).join(F.broadcast(table), "_stratum", "left")
    return joined.withColumn("rejected_by", rejected_by).withColumn("kept", F.col("rejected_by").isNull()).drop(*table.columns)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and rejected_by of every document.

    Every text is measured once; the counts, a few numbers a document, are written, then tallied with labels and judged.
    """
    rows = cut(measure(docs))
    judged = judge(with_statistics(rows), fit(with_statistics(rows), labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
