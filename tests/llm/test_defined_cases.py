"""Defined cases of the corpus operators: repeated rows and ids, nulls, empty tables, long texts, clashing columns, and brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import avi_mjpeg, byte_bpe, common, jpeg, line_dedup, mixing, near_dup, preferences, quality_model, quality_rules, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["__lost", "__lost_of", "__lost_row", "__kept_id", "__doc", "__row", "__id", "row", "size", "rank", "range", "nth", "words", "slot", "block", "copy", "lo", "hi", "digest", "_row", "_stratum", "spans", "a", "z"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, rows, more=False):
    d = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i and i % 5 == 0 else f"s{(i or 0) % 3}", 1) for i, t in rows], SCHEMA)
    return d.withColumns({c: F.lit(3) for c in CLASHING}) if more else d


def raw(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def repeated_ids():
    """Rows that repeat whole, rows that share an id but not their text, null ids, null and empty texts."""
    rng = random.Random(11)
    a, b, line = words(rng, 120), words(rng, 90), "one line that many documents share, of forty characters"
    rows = [(1, a), (1, a), (2, words(rng, 40)), (3, b), (3, words(rng, 30) + b), (4, words(rng, 20) + a + words(rng, 20)), (5, None), (5, ""), (None, a), (None, a), (None, None)]
    rows += [(6, f"{line}\nalone in six"), (6, f"alone in the other six, which has forty characters too\n{line}\nlast"), (6, f"{line}\nalone in six")]
    return rows + [(k, f"{words(rng, 12)}\n{line}") for k in range(7, 12)]


# ---------------------------------------------------------------- 1


def loop_starts(frames):
    """Shots by the definition: histogram differences against FLOOR and the mean and deviation of their neighbours."""
    hist = [[sum(1 for v in f.ravel().tolist() if v // 16 == b) / f.size for b in range(16)] for f in frames]
    d = [sum(abs(x - y) for x, y in zip(p, q)) for p, q in zip(hist, hist[1:])]
    out = [0] if frames else []
    for k, x in enumerate(d):
        near = d[max(0, k - avi_mjpeg.WINDOW) : k] + d[k + 1 : k + 1 + avi_mjpeg.WINDOW]
        mean = sum(near) / len(near) if near else 0
        spread = math.sqrt(sum((y - mean) ** 2 for y in near) / len(near)) if near else 0
        if x > (max(avi_mjpeg.FLOOR, mean + avi_mjpeg.SPREAD * spread) if near else avi_mjpeg.FLOOR):
            out.append(k + 1)
    return out


def test_shots_against_a_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 40):
        level, frames = 90, []
        for _ in range(n):
            level = int(rng.integers(0, 200)) if rng.random() < 0.25 else level
            frames.append(rng.integers(level, level + 50, (8, 16)).astype(np.uint8))
        assert avi_mjpeg.shot_starts(frames).tolist() == loop_starts(frames)


def avi_of(frames):
    """An AVI file of given JPEG frames."""
    import struct

    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) & 1)
    movi = b"movi" + b"".join(chunk(b"00dc", f) for f in frames)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13))) + chunk(b"LIST", movi))


def java_jpeg(spark, level, colour, width=50, height=37):
    """A frame made by Java's encoder, and the luma that Java's decoder finds in it."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if colour else 10)
    for y in range(height):
        for x in range(width):
            r, g, b = (level, (level + 2 * x) % 256, (3 * y) % 256) if colour else (min(255, level + x + y),) * 3
            if colour:
                image.setRGB(x, y, r << 16 | g << 8 | b)
            else:
                image.getRaster().setSample(x, y, 0, r)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if not colour:
        return data, np.array([[back.getRaster().getSample(x, y, 0) for x in range(width)] for y in range(height)])
    rgb = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(width)] for y in range(height)])
    return data, 0.299 * (rgb >> 16) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)


def without_segments(data, mark):
    out, at = data[:2], 2
    while data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big") + 2
        out += b"" if data[at + 1] == mark else data[at : at + size]
        at += size
    return out + data[at:]


def test_baseline_frames_of_another_encoder(spark):
    frames = []
    for level in (10, 12, 180, 181):
        grey, want = java_jpeg(spark, level, False)
        assert np.abs(jpeg.luma(grey).astype(int) - want).max() <= 1
        colour, want = java_jpeg(spark, level, True)
        assert np.abs(jpeg.luma(colour).astype(int) - want).mean() < 3
        assert (jpeg.luma(without_segments(colour, 0xC4)) == jpeg.luma(colour)).all()  # the standard tables
        frames.append(grey)
    files = [(1, avi_of(frames)), (2, avi_of([frames[0], frames[1][: len(frames[1]) // 2]])), (3, avi_of([b"\xff\xd8\xff\xc2\0\x04xx"])), (4, b"no film"), (5, None), (6, avi_of([])), (7, avi_of([b"\xff\xd8"]))]
    rows = avi_mjpeg.clip_rows(spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in files], "doc_id long, media binary")).collect()
    assert [(r.clip, r.first_frame, r.n_frames, r.start_s, r.end_s, r.error) for r in rows if r.doc_id == 1] == [(0, 0, 2, 0.0, 0.08, None), (1, 2, 2, 0.08, 0.16, None)]
    assert {r.doc_id for r in rows if r.error} == {2, 3, 7} and all(r.clip is None for r in rows if r.error) and len(rows) == 5


def test_damage_never_ends_the_job(spark):
    rng, good = random.Random(9), avi_mjpeg.write_avi(bytes(random.Random(1).choices(range(256), k=6400)))
    files = [(0, bytearray(good))]
    for k in range(1, 60):
        bad = bytearray(good[: rng.randrange(len(good))] if k % 2 else good)
        for _ in range(k % 3 * 4):
            bad[rng.randrange(len(bad)) if bad else 0 :][:1] = b""
            if bad:
                bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        files.append((k, bad))
    rows = avi_mjpeg.clip_rows(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert [r.error for r in rows if r.doc_id == 0] == [None] and any(r.error for r in rows)


# ---------------------------------------------------------------- 2


def sets_of(t):
    w = raw(t).lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def test_keep_first_with_repeated_ids(spark, repeated_ids):
    """Of each component one row; texts under one id that aren't linked stay each; twice is the same."""
    docs = table(spark, repeated_ids, more=True)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    out = got(kept, "doc_id", "text")
    rows = sorted(set(repeated_ids) - {(None, None)}, key=repr)
    named = [(i, t) for i, t in rows if i is not None]
    parts = []  # components of texts, by brute force
    for i, t in named:
        s = sets_of(t)
        near = [p for p in parts if s and any(x and 100 * len(s & x) >= 85 * len(s | x) for _, _, x in p)]
        parts = [p for p in parts if p not in near] + [[(i, t, s)] + [x for p in near for x in p]]
    assert [r for r in out if r[0] is None] == sorted([r for r in repeated_ids if r[0] is None], key=repr)
    chosen = [r for r in out if r[0] is not None]
    assert len(chosen) == len(set(chosen)) == len(parts)
    for p in parts:
        mine = [r for r in chosen if r in {(i, t) for i, t, _ in p}]
        assert len(mine) == 1 and mine[0][0] == min(i for i, _, _ in p)
    assert got(near_dup.keep_first(docs.repartition(5)), "doc_id", "text") == out


def test_blocks_follow_the_weight_of_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "WEIGHT", 2000)
    rng = random.Random(6)
    base = words(rng, 150).split()
    rows = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows[i] = " ".join(w)
    sets, up = {i: sets_of(t) for i, t in rows.items()}, {i: i for i in rows}
    for a in rows:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = {k: x if v == y else v for k, v in up.items()}
    assert dict(got(near_dup.near_duplicates(table(spark, rows.items())), "doc_id", "component_id")) == up


# ---------------------------------------------------------------- 3


def brute_rows(rows, n=100):
    """By the definition: a string goes if it also starts at a smaller (doc_id, start)."""
    first = {}
    for i, t in rows:
        for p in range(len(raw(t)) - n + 1) if i is not None else ():
            s = raw(t)[p : p + n]
            first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = raw(t)
        m = bytearray(len(b))
        for p in range(len(b) - n + 1) if i is not None else ():
            if first[b[p : p + n]] < (i, p):
                m[p : p + n] = b"\1" * n
        out.append((i, len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), sha(bytes(x for x, y in zip(b, m) if not y))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch,held,most", [(1 << 19, 1 << 19, 8192), (256, 300, 8192), (256, 300, 1)])
def test_suffix_dedup_with_repeated_ids(spark, repeated_ids, monkeypatch, batch, held, most):
    """Also with texts that are hashed in pieces, and with all anchors too frequent."""
    for name, value in (("BATCH", batch), ("HELD", held), ("MOST", most)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = repeated_ids + [(20 + k, words(rng, 100) + passage + words(rng, 150) * (1 + k % 2)) for k in range(6)]
    docs = table(spark, rows, more=True)
    assert got(suffix_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_rows(rows)
    assert got(suffix_dedup.dedup(docs).selectExpr("doc_id", "sha2(kept, 256) AS s"), "doc_id", "s") == sorted([(r[0], r[4]) for r in brute_rows(rows)], key=repr)


def test_suffix_dedup_of_one_very_common_passage(spark):
    """More contexts of one anchor than a transform takes, at the default."""
    rng = random.Random(13)
    passage = words(rng, 25)[:140]
    rows = [(k, words(rng, 12) + passage + words(rng, 12)) for k in range(9000)]
    found = suffix_dedup.digest(table(spark, rows)).collect()
    removed = {r.doc_id: r.n_removed for r in found}
    assert removed[0] == 0 and all(removed[k] >= len(passage) for k in range(1, 9000)) and sum(r.n_spans for r in found) == 8999


# ---------------------------------------------------------------- 4


def test_mix_of_repeated_rows(spark, repeated_ids):
    docs = table(spark, repeated_ids * 3, more=True)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    by_source = {}
    for r in rows:
        key = (r.source_size, r.target)
        by_source[key] = by_source.get(key, 0) + r.taken
    assert all(abs(n - target) <= 0.5 + 1e-6 for (_, target), n in by_source.items())
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns and got(mixing.mix(docs.repartition(7)), "doc_id", "text") == got(whole, "doc_id", "text")


def test_the_mix_is_its_schedule(spark):
    """Pieces in their slots: a slot holds one source, its block's words; what is taken is the sum; slots alternate as weights say."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, words(rng, rng.randint(0, 60)), f"s{0 if k % 3 else k % 9}", 7) for k in range(200)], "doc_id long, text string, source string, slot int")
    s = mixing.scheduled(docs)
    assert s.columns == ["slot", "n_words", *docs.columns]
    rows = [tuple(r) for r in s.collect()]
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    assert all(len(r[3].split()) == r[1] for r in rows)
    taken, of_slot = {}, {}
    for slot, n, doc, _, source, _ in rows:
        taken[doc] = taken.get(doc, 0) + n
        of_slot.setdefault(slot, set()).add(source)
    figures = mixing.mixed(docs).collect()
    assert taken == {r.doc_id: r.taken for r in figures if r.taken} and all(len(x) == 1 for x in of_slot.values())
    first = {}
    for slot, _, doc, *_ in rows:
        first[doc] = min(slot, first.get(doc, slot))
    assert all(first[r.doc_id] <= r.first_slot for r in figures if r.taken)
    sizes = {}
    for slot, n, *_ in rows:
        sizes[slot] = sizes.get(slot, 0) + n
    assert max(sizes.values()) <= 2  # a few thousand words in 65,536 slots


def test_a_source_of_one_word(spark):
    docs = spark.createDataFrame([(k, "w " * 1000, "big") for k in range(200)] + [(1000, "one", "a")], "doc_id long, text string, source string")
    r = {x.doc_id: x for x in mixing.mixed(docs).collect()}[1000]
    assert r.taken == round(r.target) == 2 and r.first_slot is not None
    assert mixing.mix(docs).where("doc_id = 1000").count() == 2


# ---------------------------------------------------------------- 5


def test_preferences_of_large_and_negative_ids(spark):
    base = 2**53
    rows = [(base + k, 0, "user", f"q{k // 2}") for k in range(2, 6)] + [(base + k, 1, "assistant", f"a{k}") for k in range(2, 6)] + [(-2, 0, "user", "x"), (-1, 0, "user", "y")]
    out = {r.pair_id: r for r in preferences.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2**52 + 1, 2**52 + 2, -1}
    for k in (1, 2):
        r = out[2**52 + k]
        assert r.n_prompt_turns == 1 and f"a{2 * k}<" in r.chosen_completion and f"a{2 * k + 1}<" in r.rejected_completion
    assert "x" in out[-1].chosen_completion and "y" in out[-1].rejected_completion
    assert preferences.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------- 6


def brute_shards(rows, limit):
    """Split by inserting in a directory: a bucket over the limit with several ids splits on its next bit."""
    bits = lambda i: "".join(f"{int(c, 16):04b}" for c in hashlib.md5(str("null" if i is None else i).encode()).hexdigest())
    todo, out = [("", [(i, len(raw(t)), bits(i)) for i, t in rows])], []
    while todo:
        at, held = todo.pop()
        n = sum(x[1] for x in held)
        if n > limit and len({x[0] for x in held}) > 1 and len(at) < 120:
            todo += [(at + b, part) for b in "01" if (part := [x for x in held if x[2][len(at)] == b])]
        else:
            out += [(i, m, len(at), at, n, len(held), n > limit) for i, m, _ in held]
    return sorted(out, key=repr)


@pytest.mark.parametrize("step", [24, 4])
def test_shards_against_splitting(spark, repeated_ids, monkeypatch, step):
    """Small steps make buckets that go on over several of them; repeated ids and null ids can't be split."""
    monkeypatch.setattr(sharding, "STEP", step)
    monkeypatch.setattr(sharding, "_DIGITS", step // 4)
    rows = repeated_ids + [(1000 + k, "x" * 50) for k in range(300)]
    for limit in (0, 49, 200, 10**6):
        out = sharding.shards(table(spark, rows, more=True), limit)
        assert got(out, "doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs", "oversized") == brute_shards(rows, limit)
    assert sharding.shards(table(spark, rows).limit(0), 9).count() == 0


def test_shards_deeper_than_one_step(spark):
    """Two ids whose hashes share 26 bits."""
    seen, k = {}, 0
    while True:
        key = hashlib.md5(str(k).encode()).digest()[:4]
        key = int.from_bytes(key, "big") >> 6
        if key in seen:
            break
        seen[key] = k
        k += 1
    rows = [(seen[key], "x" * 60), (k, "y" * 60)]
    out = sharding.shards(table(spark, rows), 100)
    assert got(out, "doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs", "oversized") == brute_shards(rows, 100)
    assert out.first().depth > 24


def test_shards_are_written(spark, repeated_ids, tmp_path):
    docs = table(spark, repeated_ids, more=True)
    sharding.write(docs, str(tmp_path / "s"), 500)
    back = spark.read.option("basePath", str(tmp_path / "s")).parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "shard"} and got(back, "doc_id", "text") == sorted(repeated_ids, key=repr)
    with pytest.raises(ValueError):
        sharding.write(docs.withColumn("shard", F.lit(1)), str(tmp_path / "t"), 500)


# ---------------------------------------------------------------- 8


def walked(model, x):
    """A row's score, tree by tree and node by node."""
    total = model.base
    for feature, cut, value in zip(model.feature, model.cut, model.value):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (1 if x[feature[node]] > cut[node] else 0)
        total += value[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_trees_are_walked_as_they_stand():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality_model.fit(x, y, trees=15, depth=3)
    assert np.allclose(model.score(x), [walked(model, row) for row in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_first_tree_takes_the_best_split():
    """One level against every split of every feature between distinct values."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        x, y = rng.integers(0, 30, (200, 4)).astype(float), rng.integers(0, 2, 200).astype(float)
        model = quality_model.fit(x, y, trees=1, depth=1)
        g, h = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_model.DECAY)
        gains = {}
        for f in range(4):
            for border in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])):
                left = x[:, f] <= border
                if min(left.sum(), (~left).sum()) >= quality_model.LEAST:
                    gains[f, border] = part(left) + part(~left) - part(np.ones(200, bool))
        chosen = gains[model.feature[0][0], model.cut[0][0]]
        assert chosen == pytest.approx(max(gains.values()))
        left = x[:, model.feature[0][0]] <= model.cut[0][0]
        for side, value in ((left, model.value[0][0]), (~left, model.value[0][1])):
            assert value == pytest.approx(quality_model.RATE * g[side].sum() / (h[side].sum() + quality_model.DECAY))


def test_classifier_of_one_label_and_of_repeated_rows(spark, repeated_ids):
    docs = table(spark, repeated_ids, more=True)
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i, _ in repeated_ids], "doc_id long, quality int")
        assert {r.score for r in quality_model.score(docs, quality_model.train(docs, labels)).collect()} == {float(label)}
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    one, many = (quality_model.train(d, labels) for d in (docs, docs.unionByName(docs).repartition(3)))
    assert one.base == many.base and (one.value == many.value).all()
    assert quality_model.train(docs.limit(0), labels).base == 0.0 and quality_model.keep_good(docs, one).columns == docs.columns


# ---------------------------------------------------------------- 9


def brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\r\x0b\x0c")
        return "".join(c.lower() if c.isascii() else c for c in k) if len(k) >= 40 else None

    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else ():
            if key(line) is not None:
                docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) is None or len(docs[key(x)]) < 5 or max(docs[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out, key=repr)


def test_line_dedup_with_repeated_ids(spark, repeated_ids):
    docs = table(spark, repeated_ids, more=True)
    assert got(line_dedup.digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(repeated_ids)
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and "alone in the other six" in " ".join(r.text or "" for r in out.where("doc_id = 6").collect())


# ---------------------------------------------------------------- 10


def test_rules_end_to_end_against_plain_python(spark):
    """Counts, cutoffs and verdicts of a corpus with junk in two languages, one of them without enough labels."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(2600):
        good = i % 4 != 0
        w = words(rng, rng.randint(55, 70)).split()
        if not good:
            w = [x + "#$%" if k % 3 else x for k, x in enumerate(w)]
        elif i % 50 == 1:
            w[0] += "#"
        rows.append((i, " ".join(w) + "\n" + " ".join(w[:4]), "en" if i % 10 else "de", "s", 1))
        if i % 13:
            labels.append((i, int(good)))
    rows += [(None, "# # #", "en", "s", 1), (9001, None, None, "s", 1), rows[5], rows[5]]
    labels += [(5, 1), (7, 0), (None, 1), (8, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})
    found = quality_rules.apply(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    label = {}
    for i, q in labels:
        if q is not None and i is not None:
            label[i] = min(q, label.get(i, 1))

    def figures(t):
        w = (t or "").split()
        n, chars, lines = len(w), sum(map(len, w)), [x for x in (t or "").split("\n") if x.split()]
        grams = [tuple(w[k : k + 3]) for k in range(n - 2)]
        again = len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})
        share = lambda a, b: a / b if b else 0.0
        s = {"symbol_share": share(sum((t or "").count(c) for c in "#*$%&|<>"), chars), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)), "repeat_word_share": share(again, n), "word_length_high": share(chars, n), "word_length_low": share(chars, n)}
        return s, n < 50 or 100 * again > 50 * n

    rejects = lambda s, rule, cutoff: s[rule] > cutoff if quality_rules.RULES[rule][0] == "above" else s[rule] < cutoff
    strata, every = {}, [(i, lang, *figures(t)) for i, t, lang, _, _ in rows]
    for i, lang, s, base in every:
        if label.get(i) == 1 and not base:
            strata.setdefault(lang or "", []).append(s)
    error, risk = quality_rules.ERROR / (len(quality_rules.RULES) * len(strata)), quality_rules.RISK / len(quality_rules.RULES)
    cutoffs = {}
    for lang, held in strata.items():
        for rule, (_, grid) in quality_rules.RULES.items():
            for cutoff in grid:
                k, n = sum(rejects(s, rule, cutoff) for s in held), len(held)
                # P(X <= k) at the allowed rate: small enough means that the rate is under it.
                if sum(math.exp(math.log(math.comb(n, j)) + j * math.log(risk) + (n - j) * math.log1p(-risk)) for j in range(k + 1)) > error:
                    break
                cutoffs[lang, rule] = cutoff
    assert any(lang == "en" for lang, _ in cutoffs) and not any(lang == "de" for lang, _ in cutoffs)
    want = sorted(((i, base, not base and not any((lang or "", r) in cutoffs and rejects(s, r, cutoffs[lang or "", r]) for r in quality_rules.RULES)) for i, lang, s, base in every), key=repr)
    assert sorted(((r.doc_id, r.base_failed, r.kept) for r in found), key=repr) == want
    assert 0.2 < sum(not k for _, _, k in want) / len(want) < 0.3
    assert quality_rules.apply(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_bounds_of_large_counts():
    for k, n in ((10_000, 400_000), (1, 5_000_000), (0, 1000)):
        p = quality_rules.upper_bound(k, n, 1e-4)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(max(0, k - 2000), k + 1)]
        assert sum(map(math.exp, logs)) == pytest.approx(1e-4, rel=1e-4)


# ---------------------------------------------------------------- all, and the pipeline


OPERATORS = [
    avi_mjpeg.digest, lambda d: avi_mjpeg.clip_rows(avi_mjpeg.encode(d)), near_dup.near_duplicates, near_dup.keep_first, suffix_dedup.digest, mixing.mixed, mixing.mix, mixing.scheduled,
    lambda d: sharding.shards(d, 100), byte_bpe.digest, line_dedup.digest, line_dedup.dedup,
]


@pytest.mark.parametrize("run", OPERATORS)
def test_clashing_columns_change_nothing(spark, repeated_ids, run):
    plain, more = run(table(spark, repeated_ids)), run(table(spark, repeated_ids, more=True))
    names = [c for c in plain.columns if c not in ("slot",)]
    assert got(plain, *names) == got(more.select(*[more[c] for c in names]), *names)
    assert run(table(spark, repeated_ids).limit(0)).count() == 0


@pytest.fixture
def folder(spark, repeated_ids, tmp_path):
    def write(rows):
        table(spark, rows, more=True).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(i, i % 2, 0) for i in range(4, 12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_pipeline_of_odd_rows(spark, repeated_ids, folder):
    """Every stage keeps the columns, null and empty texts and repeated rows don't stop it, and its rows are those of its parts."""
    d = folder(repeated_ids)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
    out = corpus_pipeline.run(spark, d)
    rows = [r.asDict() for r in out.collect()]
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert {r["doc_id"] for r in rows} <= {i for i, _ in repeated_ids}


def test_pipeline_of_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_fold_is_the_stated_one(spark):
    ids = list(range(-3, 40)) + [2**53 + 1]
    d = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", quality_model.fold(F.col("doc_id")).alias("f"))
    assert {r.doc_id: r.f for r in d.collect()} == {i: zlib.crc32(str(i).encode()) % 5 for i in ids}
