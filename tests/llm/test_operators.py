"""The corpus operators against brute force, round trips and defined cases on small tables."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import avi_mjpeg, byte_bpe, common, components, line_dedup, mixing, near_dup, preferences, quality_model, quality_rules, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lost string, text_ string, rank int, cls int, spans string, task int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts with copies, near copies, shared passages and lines, nulls, empty and long texts."""
    rng = random.Random(1)
    base = [words(rng, n) for n in (120, 300, 60, 200, 4, 5, 6)]
    passage, line = words(rng, 60), "Shared LINE of more than forty code points é " + words(rng, 3)
    out = [None, "", "   \n\t", "a" * 2500, "ab " * 1500, words(rng, 4000), "|#|" * 40]
    out += base + [base[0], base[1].upper(), base[0] + " one more"]
    for _ in range(12):
        w = base[1].split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    out += [words(rng, 30) + " " + passage + " " + words(rng, 20) for _ in range(6)]
    out += [f"{words(rng, 8)}\n {line.lower()} \n{line}\n" for _ in range(7)]
    return dict(enumerate(out))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i and i % 5 == 0 else f"s{(i or 0) % 3}", 1, "x", "y", 1, 2, "z", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts.items()).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def raw(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---------------------------------------------------------------- 1


def test_avi(spark, docs, texts):
    got = by_id(avi_mjpeg.digest(docs))
    media = by_id(avi_mjpeg.encode(docs))
    for i, t in texts.items():
        b = raw(t)
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-64:]))
        assert r.media_sha256 == sha(bytes(media[i].media)) and r.media_bytes == len(media[i].media)
    clips = avi_mjpeg.clip_rows(avi_mjpeg.encode(docs)).collect()
    assert sum(c.n_frames for c in clips) == sum(r.n_frames for r in got.values()) and {c.doc_id for c in clips} == set(texts)


def test_avi_decoders_agree():
    rng = np.random.default_rng(0)
    payload = np.concatenate([rng.integers(0, 40, 4096), rng.integers(200, 256, 4096)]).astype(np.uint8).tobytes()
    data = avi_mjpeg.write_avi(payload)
    _, frames = avi_mjpeg.read_index(data)
    fast = avi_mjpeg.decode_frames(data, frames)
    for (at, size), f in zip(frames, fast):
        jpeg = data[at : at + size]
        h, w, p, table_, _, start = avi_mjpeg._head(jpeg)
        assert (avi_mjpeg._slow(jpeg[start:-2].replace(b"\xff\x00", b"\xff"), h, w, p, table_) == f).all()
    assert avi_mjpeg.shot_starts(fast).tolist() == [0, 4]
    cut = data.index(b"idx1")
    assert avi_mjpeg.read_index(data[:cut])[1] == frames and avi_mjpeg.read_index(b"no file") == (0.0, [])


# ---------------------------------------------------------------- 2


def sets_of(t):
    w = raw(t).lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def components_of(sets, linked):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def link(a, b):
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def test_near_duplicates(spark, docs, texts):
    sets = {i: sets_of(t) for i, t in texts.items()}
    want = components_of(sets, link)
    got = by_id(near_dup.near_duplicates(docs))
    for i in texts:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """Independent edits of one text: many pairs near the threshold, in several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(5)
    base = words(rng, 150).split()
    rows = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows[i] = " ".join(w)
    sets = {i: sets_of(t) for i, t in rows.items()}
    want = components_of(sets, link)
    assert len(set(want.values())) > 10
    assert {i: r.component_id for i, r in by_id(near_dup.near_duplicates(table(spark, rows.items()))).items()} == want


def test_near_duplicates_whose_sketches_agree_in_a_band_that_is_not_shared(spark):
    """Band 0 agrees in every low byte but not in its hash; the pair's first shared bucket is band 1's."""
    low = bytes(range(near_dup.COORDS))
    bands = [[*range(near_dup.QUERY.bands)], [-1, *range(1, near_dup.QUERY.bands)]]
    rows = [(7, 1, cls, cls, 100, low, bands[cls], 0) for cls in (0, 1)]
    blocks = spark.createDataFrame(rows, "task long, band int, cls long, comp long, n_shingles long, sketch binary, bands array<long>, block int")
    columns = ["task", "band", "cls", "comp", "n_shingles", "sketch", near_dup._packed(F.col("bands")).alias("keys"), "block"]
    pairs = by_id(near_dup._within(blocks.coalesce(1).select(*columns)).withColumnRenamed("cls", "doc_id"))
    assert np.frombuffer(pairs[0].partners, "<i8").tolist() == [1] and set(pairs) == {0, 1}


def test_near_duplicates_at_either_threshold(spark):
    """Links at 0.8 and at 0.85 are those that brute force finds."""
    rng = random.Random(8)
    rows = {}
    for k in range(30):
        w = words(rng, 150).split()
        rows[2 * k] = " ".join(w)
        for i in range(k % 5):
            w[20 + 25 * i] = "edit"
        rows[2 * k + 1] = " ".join(w)
    left = []
    sets, docs = {i: sets_of(t) for i, t in rows.items()}, table(spark, rows.items())
    for at, kept in ((80, near_dup.keep_first(docs, near_dup.STAGE)), (85, near_dup.keep_first(docs))):
        want = components_of(sets, lambda a, b: 100 * len(a & b) >= at * len(a | b))
        assert {r.doc_id for r in kept.collect()} == set(want.values())
        left.append(len(set(want.values())))
    assert left[0] < left[1]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    for share in (0.5, 0.85, 0.95):
        n = int(len(a) * share)
        s = near_dup.signatures([a, np.concatenate([a[:n], np.unique(rng.integers(0, 1 << 63, len(a) - n).astype(np.uint64))])])
        true = n / (2 * len(a) - n)
        assert abs((s[0] == s[1]).mean() - true) < 5 * (true * (1 - true) / near_dup.COORDS) ** 0.5


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40) if k != 20] + [(100, 100)]
    got = {r.node: r.label for r in components.label(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == (0 if k <= 20 else 21) for k in range(41))


# ---------------------------------------------------------------- 3


def brute_spans(texts, n=100):
    seen, out = set(), {}
    for i in sorted(texts):
        t = raw(texts[i])
        m = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if t[p : p + n] in seen:
                m[p : p + n] = b"\1" * n
            seen.add(t[p : p + n])
        out[i] = (len(t), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), sha(bytes(b for b, x in zip(t, m) if not x)))
    return out


@pytest.mark.parametrize("most", [8192, 1])
def test_suffix_dedup(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.digest(docs)).items()}
    assert got == brute_spans(texts)


def test_transform_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choices(b"ab\0", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        n, starts, seen, want = rng.choice([1, 2, 5, 8]), np.arange(len(parts)) * 1000, set(), set()
        for c, s in zip(parts, starts.tolist()):
            for p in range(len(c) - n + 1):
                want |= {s + p} if c[p : p + n] in seen else set()
                seen.add(c[p : p + n])
        assert set(suffix_dedup.repeated(parts, starts, n).tolist()) == want


# ---------------------------------------------------------------- 4, 5, 6, 9 by SQL, and their defined cases


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    out = c.sql(sql)
    return out.columns, out.fetchall()


def same(df, want):
    """The same rows in any order; columns by name."""
    plain = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda names, found: sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found)
    assert sorted(df.columns) == sorted(want[0]) and rows(df.columns, [tuple(r) for r in df.collect()]) == rows(*want)


def test_mix(spark, docs, texts):
    same(mixing.mixed(docs), duck(mixing.ORACLE_SQL, documents=docs.select("doc_id", "text", "source")))
    got = by_id(mixing.mixed(docs))
    assert all(r.taken <= 2 * r.size for r in got.values()) and sum(r.taken for r in got.values()) == pytest.approx(1.5 * sum(r.size for r in got.values()), rel=0.01)
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns
    taken = {r.doc_id: r.n for r in whole.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert taken == {i: r.taken for i, r in got.items() if r.taken}


def test_mix_takes_small_sources(spark):
    """Sources of less than a slot, and more sources than slots would hold, take their targets all the same."""
    rows = [(k, "big " * 300_000, "big") for k in range(10)] + [(100 + k, "a few words " * (1 + k % 3), f"small{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert all(r.taken == round(r.target) > 0 and r.first_slot is not None for r in got if r.source != "big")
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), rel=0.01)
    taken = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert taken == {r.doc_id: r.taken for r in got if r.taken}


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, None, ""), (4, 0, "system", "s"), (None, 0, "user", "x"), (6, 0, "user", "q"), (6, 0, "user", "q"), (7, 0, "user", "q")]
    turns = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, prompt int, chosen string")
    same(preferences.formatted(turns), duck(preferences.ORACLE_SQL, conversations=turns.select("conv_id", "turn", "role", "text")))
    got = {r.pair_id: r for r in preferences.formatted(turns).collect()}
    assert got[0].n_prompt_turns == 1 and got[0].chosen_completion == "<|im_start|>assistant\na<|im_end|>\n" and got[0].rejected_mask == "1"
    assert got[1].n_prompt_turns == 1 and got[1].chosen_completion == "" and got[2].rejected_completion == "" and got[3].n_prompt_turns == 1 and got[3].chosen_mask == "0"


def test_shards(spark, docs, texts):
    for limit in (2000, 1 << 30):
        same(sharding.shards(docs, limit), duck(sharding.oracle_sql(limit), documents=docs.select("doc_id", "text")))
        got = sharding.shards(docs, limit).collect()
        assert len(got) == len(texts) and all(r.shard_bytes <= limit or r.oversized for r in got)


def test_line_dedup(spark, docs, texts):
    same(line_dedup.digest(docs), duck(line_dedup.ORACLE_SQL, documents=docs.select("doc_id", "text")))
    out = by_id(line_dedup.dedup(docs))
    assert sum(r.text != texts[i] for i, r in out.items()) >= 6 and line_dedup.dedup(docs).columns == docs.columns


# ---------------------------------------------------------------- 7


def test_bpe(spark, docs, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["  a  b\n c", " x", "x ", "I'll  don't\t\n 's", "a  b \x1c c\x85 d", "ünï 12３ ½ ...  !!", " \n\n x\n\n", "<|endoftext|>", "a" * 999 + " b", "中文 字 test", "a, b. c; d e  f"]
    more = table(spark, list(texts.items()) + list(enumerate(odd, 1000)))
    every = texts | dict(enumerate(odd, 1000))
    got, ids = by_id(byte_bpe.digest(more)), by_id(byte_bpe.encode(more))
    back = by_id(byte_bpe.decode(byte_bpe.encode(more)))
    for i, t in every.items():
        want = enc.encode_ordinary(t or "")
        assert ids[i].ids == want, t
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), sha(np.array(want, "<u4").tobytes()), sha(raw(t))) and bytes(back[i].bytes) == raw(t)


def test_bpe_ways_agree():
    import public_tokenizers as P

    c, rng = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(4)
    some = [bytes(rng.choices(b"aeinrst \xc3\xa9", k=rng.randint(1, 32))) for _ in range(500)]
    for w, ids in zip(some, byte_bpe.merge_many(some, c.table, c.singles)):
        assert np.frombuffer(ids, "<u4").tolist() == byte_bpe.merge(w, c.pairs, c.single)


# ---------------------------------------------------------------- 8


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    got = quality_model.score(docs, model)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9 and got.where("score < 0 or score > 1").isEmpty()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.limit(50).collect())


def test_classifier_defined_cases(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2, None) for i in texts] + [(1, None, 1), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, labels)
    got = quality_model.score(docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), model)
    assert got.count() == 2 * len(texts) and got.where("doc_id is null and held_out").isEmpty()
    none = quality_model.train(docs, labels.limit(0))
    assert {r.score for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.keep_good(docs, none).count() == len(texts) and quality_model.score(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- 10


def test_rule_counts(spark, docs, texts):
    got = by_id(quality_rules.apply(docs, spark.createDataFrame([], "doc_id long, quality int")))
    for i, t in texts.items():
        w = raw(t).split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 2000 else None
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want and (twice is None or r.n_repeat_words == len(twice))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_bounds():
    import math

    for k, n in ((0, 100), (3, 200), (10, 50)):
        p = quality_rules.upper_bound(k, n, 0.01)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.01, rel=1e-6)
    few = {"en": (20, {r: [0] * len(g) for r, (_, g) in quality_rules.RULES.items()})}
    many = {"en": (5000, {r: [0, 400] + [500] * (len(g) - 2) for r, (_, g) in quality_rules.RULES.items()})}
    assert quality_rules.choose(few) == {}
    assert quality_rules.choose(many) == {"en": {r: g[0] for r, (_, g) in quality_rules.RULES.items()}}


def test_every_language_gets_cutoffs(spark):
    """70 languages, all with enough good documents: junk is rejected in each, and in none without labels."""
    counted = "id AS doc_id, concat('l', id % 70) AS lang, 100 AS n_words, 500 AS word_chars, 0 AS n_symbols, 0 AS n_dup_lines, 0 AS n_repeat_words, 9 AS n_lines"
    rows = quality_rules.with_statistics(spark.sql(f"SELECT {counted} FROM range(70000)"))
    cutoffs = quality_rules.fit(rows, rows.selectExpr("doc_id", "1 AS quality"))
    assert set(cutoffs) == {f"l{k}" for k in range(70)}
    junk = quality_rules.with_statistics(spark.sql(f"SELECT {counted.replace('0 AS n_symbols', '400 AS n_symbols')} FROM range(70)"))
    got = quality_rules.judge(junk.unionByName(junk.limit(1).withColumn("lang", F.lit("unlabelled"))), cutoffs).collect()
    assert {(r.lang, r.rejected_by) for r in got} == {(f"l{k}", "symbol_share") for k in range(70)} | {("unlabelled", None)}


# ---------------------------------------------------------------- empty tables, null ids


@pytest.mark.parametrize("run", [avi_mjpeg.digest, near_dup.near_duplicates, suffix_dedup.digest, mixing.mixed, lambda d: sharding.shards(d, 100), byte_bpe.digest, line_dedup.digest, mixing.mix, line_dedup.dedup, near_dup.keep_first])
def test_empty_and_null_ids(spark, docs, run):
    assert run(docs.limit(0)).count() == 0
    odd = table(spark, [(None, "one two three four five"), (None, "one two three four five"), (None, None), (7, "one two three four five"), (7, "one two three four five")])
    assert run(odd).count() > 0


def test_memos_of_other_modules_end_with_their_stage():
    near_dup._HASH.clear()
    common.alone(near_dup.__name__)
    near_dup.shingles(b"one two three four five six")
    common.alone(near_dup.__name__)
    assert len(near_dup._HASH) == 6
    common.alone(byte_bpe.__name__)
    assert not near_dup._HASH


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"a": list(range(2 * common.SLICE + 1))})
    parts = list(common.slices([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [common.SLICE, common.SLICE, 1]
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
