"""Golden cases of sources' documents, joins with short needles, the generator's rates, and plans that don't depend on partitions."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.operators import catalog, convert, match, models, pages, pools, sample, synth, validate
from ledgerline.plans import queries
from ledgerline.sources import metadata, readers, sinks

D = "/root/testdata/sf0.001"
UUID = "4adf9ec0-317a-0134-03ad-00505686a51c"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs(spark, *documents):
    return frame(spark, [(k, json.dumps(x)) for k, x in enumerate(documents, 1)], "p int, j string")


# ---------------------------------------------------------------- documents of sources


def test_library_collection(spark):
    got = metadata.collection_items(docs(spark, {"items": [{"id": f"https://x/{UUID}", "label": {"en": ["Trow 1850", "no"], "fr": [], "xx": ["Zweite"]}}, {"id": "https://x/none", "label": "lost"}]}), "j").collect()
    assert [(r.source, r.id, r.title, r.publisher, r.year, r.holding_institution) for r in got] == [("nypl", UUID, "Trow 1850 Zweite", "Trow", "1850", "NYPL")]


def test_search_stops_where_the_listing_ends(spark):
    page = lambda found, *ids: {"response": {"numFound": found, "docs": [{"identifier": i, "title": "t", "date": "1850"} for i in ids]}}
    rows = lambda d: [r.id for r in metadata.search_pages(d, "p", "j", per=2).orderBy("id").collect()]
    assert rows(docs(spark, page(3, "a", "b"), page(3, "c"), page(3, "late"))) == ["a", "b", "c"]
    assert rows(docs(spark, page(9, "a", None), page(9), page(9, "late"))) == ["a"]
    assert metadata.search_pages(docs(spark, page(1, "a")), "p", "j").first().holding_institution == "Internet Archive"
    single = metadata.search_pages(docs(spark, page(1, "one")), "p", "j")
    assert [r.id for r in metadata.with_fallback(metadata.search_pages(docs(spark, page(0)), "p", "j"), single).collect()] == ["one"]


def test_congress_listings(spark):
    hits = [{"id": "http://www.loc.gov/item/77/", "type": ["Text"]}, {"id": "http://www.loc.gov/resource/88/?st=x", "type": []}, {"id": "", "url": "https://www.loc.gov/item/99"}, {"id": "http://www.loc.gov/collections/z/", "type": ["text"]}, {"id": "http://www.loc.gov/item/11/", "type": ["map"]}]
    assert [r.id for r in metadata.congress_results(docs(spark, {"results": hits}), "j").collect()] == ["77", "88", "99"]
    several = docs(spark, {"results": hits[:2]}, {"results": hits[2:3]}, {"results": [{"id": "http://www.loc.gov/item/late/"}]})
    assert [r.id for r in metadata.congress_results(several, "j", "p", per=2).collect()] == ["77", "88", "99"]
    item = frame(spark, [("https://www.loc.gov/item/55/?x", json.dumps({"item": {"title": "T 1850", "id": "other"}}))], "u string, j string")
    assert [(r.id, r.year) for r in metadata.congress_item(item, "j", "u").collect()] == [("55", "1850")]


def test_iiif_documents(spark):
    both = {"type": "Collection", "items": [{"id": "i", "label": "a"}, {"label": "no id"}], "manifests": [{"id": "m"}]}
    old = {"@type": "sc:Collection", "manifests": [{"@id": "m", "label": ["x", "y"]}]}
    one = {"type": "Manifest", "id": "its own", "label": {"en": ["first", "second"]}, "items": [{"id": "canvas"}]}
    d = docs(spark, both, old, one).withColumn("u", F.concat(F.lit("http://u"), "p"))
    assert sorted((r.id, r.title) for r in metadata.iiif(d, "j", "u").collect()) == [("http://u3", "first"), ("i", "a"), ("m", "x y")]


def test_manifest_cache_and_tries(spark):
    v = frame(spark, [("ia", "a"), ("ia", "b"), ("what", "c")], "source string, id string")
    cache = frame(spark, [("ia", "a", "x" * 101), ("ia", "b", "short")], "source string, id string, body string")

    def fetch(url):
        raise TimeoutError(url)

    got = {r.id: (r.body, r.error) for r in metadata.fetched(v, cache, fetch, tries=2, wait=0).collect()}
    assert got["a"] == ("x" * 101, None) and got["b"][0] is None and "TimeoutError" in got["b"][1] and got["c"] == (None, "unknown source")


# ---------------------------------------------------------------- joins, selection, pools


@pytest.mark.parametrize("few", [256, 0])
def test_short_needles(spark, monkeypatch, few):
    monkeypatch.setattr(match, "FEW", few)
    texts = ["kings road", "a", "", None, "ünïcode é road roads", "x" * 40 + "road of many kings", "kings road"]
    pins = ["ki", "d", "é", "road", "kings road", "of many kings", "ö", " ", "xxxxxxxxxxxxxxxx", "roads!"]
    d, p = frame(spark, list(enumerate(texts)), "k int, t string"), frame(spark, list(enumerate(pins)), "pos int, n string")
    got = {(r.k, r.n) for r in match.contained(d, "k", "t", p, "n").collect()}
    assert got == {(k, n) for k, t in enumerate(texts) for n in pins if n.strip() and n in (t or "")}
    folded = {(r.k, r.n) for r in match.contained(d.withColumn("t", F.upper("t")), "k", "t", p, "n", fold=True).collect()}
    assert folded == got
    assert {r.k: r.n for r in match.longest_contained(d, "k", "t", p, "n", "pos").collect()} == {k: max((n for j, n in got if j == k), key=len) for k, _ in got}


def test_folders_of_a_worklist(spark):
    d = frame(spark, [(1, "dir v1 ABC-9"), (2, "other")], "k int, hay string")
    ids = frame(spark, [("abc-9",), (" ",)], "id string")
    assert [r.k for r in match.selected_folders(d, "k", "hay", ids).collect()] == [1]
    assert match.selected_folders(d, "k", "hay", ids.limit(0)).count() == 0 and match.selected_folders(d, "k", "hay", ids, use_worklist=False).count() == 2


def test_picks_by_counts_are_picks_by_rank(spark):
    rows = [(k, f"s{k % 3 if k % 7 else 0}", None if k % 11 == 0 else k * k % 13) for k in range(200)]
    d = frame(spark, rows, "k int, s string, y int")
    for per in (1, 2, 5, 300):
        want = set()
        for s in {r[1] for r in rows}:
            members = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
            n = len(members)
            at = {n // 2} if per == 1 else set(range(n)) if n <= per else {round(i * (n - 1) / (per - 1)) for i in range(per)}
            want |= {members[i][0] for i in at}
        assert {r.k for r in sample.select(d, F.col("s"), ["y", "k"], per).collect()} == want


def test_pool_parts_are_those_of_one_running_sum(spark):
    rows = [(f"{c}{k}", float(k + 1)) for k in range(40) for c in ("a", "ab", "é", "")]
    got = {r.term: (r.lo, r.hi) for r in pools.cumulative(frame(spark, rows, "term string, weight double")).collect()}
    total, at = sum(w for _, w in rows), 0.0
    for term, w in sorted(rows, key=lambda r: r[0].encode()):
        assert got[term] == (at / total, (at + w) / total)
        at += w


def test_new_rows_keep_the_first_of_a_common_key(spark):
    fresh = frame(spark, [(k, "ia", f"i{k % 3}") for k in range(300)], "pos int, source string, id string").repartition(7)
    assert sorted(r.pos for r in catalog.new_rows(fresh, "pos", fresh.limit(0).select("source", "id")).collect()) == [0, 1, 2]
    assert sorted((r.id, r.pos) for r in catalog.index_by_id(fresh, "pos").collect()) == [("i0", 297), ("i1", 298), ("i2", 299)]


# ---------------------------------------------------------------- pages, records


def test_pages_to_read(spark):
    rows = [("v", "0000"), ("v", "0001"), ("v", "0040"), ("v", "0041"), ("w", "0000"), ("w", "0003")]
    d = frame(spark, [(v, f"{v}/{n}_x.jpg") for v, n in rows], "v string, path string")
    done = frame(spark, [("v/0041_x.jpg",)], "path string")
    read = lambda every: sorted(r.path for r in pages.to_read(d, "v", pages.canvas_index(F.col("path")), done, "path", every).collect())
    assert read(False) == ["v/0040_x.jpg", "w/0000_x.jpg", "w/0003_x.jpg"] and len(read(True)) == 5


def test_a_bad_image_costs_no_other(spark):
    def load():
        def model(images):
            if b"bad" in images:
                raise ValueError
            return [[((1, 2, 3, 4), x.decode(), 1)] for x in images]

        return model

    got = {r.path: (r.status, [x.text for x in r.lines]) for r in models.read_pages(frame(spark, [("a", bytearray(b"one")), ("b", bytearray(b"bad")), ("c", bytearray(b"two"))], "path string, content binary").coalesce(1), load).collect()}
    assert got == {"a": ("ok", ["one"]), "b": ("failed", []), "c": ("ok", ["two"])}


@pytest.mark.parametrize("value,want", [("true", True), ("false", False), ('"false"', True), ('""', False), ("0", False), ("1.5", True), ("null", False), ("[]", True)])
def test_imported_truth(spark, value, want):
    r = spark.range(1).select(convert.imported_record(F.try_parse_json(F.lit(f'{{"is_business": {value}, "name": "a"}}'))).alias("r")).first().r
    assert r.is_business is want and r.name == "a" and r.employer == ""


def test_lines_in_splits(spark, tmp_path):
    """Files that are read in several pieces, with each kind of line end."""
    (tmp_path / "a.txt").write_bytes(b"".join(f"line {k}".encode() + (b"\n", b"\r\n")[k % 2] for k in range(500)))
    (tmp_path / "b.txt").write_bytes(b"first\nsecond\n\nfourth")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = {(r.file[-5:], r.pos): r.line for r in readers.text_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got["a.txt", k] for k in range(500)] == [f"line {k}" for k in range(500)] and [got["b.txt", k] for k in range(4)] == ["first", "second", "", "fourth"] and len(got) == 504


def test_lines_of_a_folder(spark, tmp_path):
    """Places go on from file to file of a folder, in order of names; a template in it doesn't count, nor other folders."""
    for name, lines in (("v/b 2.txt", range(200, 203)), ("v/a.txt", range(200)), ("v/b!1.txt", range(203, 250)), ("v/b+%é.txt", range(250, 300)), ("v/A_Template.txt", [-1]), ("w/a.txt", range(2))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f"line {k}\n" for k in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = sorted((r.file.split("/")[-2], r.pos, r.line) for r in readers.text_lines(spark, f"{tmp_path}/*", by="folder").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(v, k, f"line {k}") for v, n in (("v", 300), ("w", 2)) for k in range(n)]


@pytest.mark.parametrize("by", ["file", "folder"])
def test_lines_beside_a_large_template(spark, tmp_path, by):
    """Spark cuts files by the sizes of all that it reads: no line is lost when one of those is left out."""
    for name in ("a.txt", "template.txt"):
        (tmp_path / name).write_text("".join(f"line {k}\n" for k in range(500)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        d = [readers.text_lines(spark, str(tmp_path), by=by), readers.numbered_lines(spark, str(tmp_path)).where("file not like '%/template.txt'")]
        got = [sorted((r.pos, r.line) for r in x.collect()) for x in d]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [[(k, f"line {k}") for k in range(500)]] * 2


def test_tables_keep_quotes(spark, tmp_path):
    value = 'a "quoted", text\\ with a line\nend'
    sinks.append_rows(frame(spark, [("ia", "1", value)], "source string, id string, title string"), str(tmp_path / "t"))
    assert readers.csv_rows(spark, str(tmp_path / "t")).first().title == value


# ---------------------------------------------------------------- the generator


def test_rates_of_the_generator(spark):
    """Within two points of what they are to be, by profile and era."""
    d = synth.generate(spark, 12_000, seed=5).cache()
    rows = [r.asDict(recursive=True) for r in d.collect()]
    share = lambda rows, test: sum(map(test, rows)) / max(len(rows), 1)
    city, town = [r for r in rows if r["profile"] == "metropolis"], [r for r in rows if r["profile"] == "town"]
    people = lambda rs: [r for r in rs if not r["record"]["is_business"]]
    close = lambda got, want: abs(got - want) < 0.02
    assert close(len(city) / len(rows), 0.75)
    for era, want in (("early", 0.18), ("mid", 0.50), ("late", 0.32)):
        assert close(share(city, lambda r: r["era"] == era), want)
    eras = {e: people([r for r in city if r["era"] == e]) for e in ("early", "mid", "late")}
    assert close(share(city, lambda r: r["record"]["is_business"]), 0.03) and close(share(town, lambda r: r["record"]["is_business"]), 0.06)
    assert all(close(share(eras[e], lambda r: r["ditto"]), p) for e, p in (("early", 0), ("mid", 0.05), ("late", 0.14)))
    two = lambda p: p + (1 - p) * 0.03
    assert all(close(share(eras[e], lambda r: r["record"]["home_address"] != ""), two(p)) for e, p in (("early", 0.15), ("mid", 0.35), ("late", 0.35)))
    assert close(share(eras["late"], lambda r: "/" in r["context"]["directory_year"]), 0.4) and share(eras["mid"], lambda r: "/" in r["context"]["directory_year"]) == 1
    assert close(share(people(city), lambda r: r["record"]["spouse_name"] != ""), 0.28 * 0.30) and close(share(people(town), lambda r: r["record"]["race_designation"] != ""), 0.085)
    assert close(share(people(town), lambda r: r["record"]["occupation_role"] == ""), 0.27) and 0.2 < share(rows, lambda r: r["raw_line"] != r["clean_line"]) < 0.35
    ogden = people([r for r in city if r["context"]["publisher"] == "ogden"])
    assert ogden and all(r["record"]["race_designation"] in ("", "*") for r in ogden)
    years = {"franks": (1786, 1787), "duncan": (1788, 1796), "mb": (1931, 1933), "hearne": (1852, 1855), "boyd": (1885, 1895), "ogden": (1838, 1841)}
    for r in city:
        lo, hi = years.get(r["context"]["publisher"], (0, 9999))
        assert lo <= int(r["context"]["directory_year"][:4]) <= hi
        assert not (r["context"]["publisher"] == "mb" and r["record"]["home_address"] == "" and r["record"]["address"][:2] in ("h ", "r "))
    stats = {(r.profile, r.feature): r.n for r in synth.statistics(d, "profile").collect()}
    assert len({f for _, f in stats}) >= 40 and stats["metropolis", "two_addresses"] == sum(r["record"]["home_address"] != "" for r in city)
    assert sum(r.n for r in synth.publisher_mix(d).collect()) == len(rows)


def test_generator_draws_from_given_pools(spark):
    surnames = pools.tempered(frame(spark, [("Zyx", 100), ("Wvu", 1)], "term string, count long"), frame(spark, [("Wvu", 4)], "term string, count long"))
    trades = pools.blended(frame(spark, [("smith", 1.0)], "term string, weight double"), frame(spark, [("farrier", 1)], "term string, count long"))
    rows = synth.generate(spark, 300, surnames=surnames, occupations=trades).where("profile = 'metropolis' and not ditto").collect()
    assert {r.context.alphabetical_range for r in rows} == {"ZYX", "WVU"}
    assert any("smith" in r.record.occupation_role for r in rows) and any("farrier" in r.record.occupation_role for r in rows)


# ---------------------------------------------------------------- plans


SOME = ["score_fields", "results_pivot_last_wins", "anti_dedup", "interval_rebuild", "carry_forward", "roundrobin_cap", "term_pool_merge", "weighted_draw", "page_lines", "jaccard_match", "duplicate_flags"]


@pytest.mark.parametrize("name", SOME)
def test_results_do_not_depend_on_partitions(spark, name):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
            seen.append(sorted(map(repr, queries.QUERIES[name](spark, D).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_every_rule_fires(spark):
    rules = {r.rule for r in queries.QUERIES["validate_lines"](spark, D).collect()}
    assert len(rules) == 18 and validate.failed(validate.check_lines(frame(spark, [("f", 1, "{")], "file string, line int, value string")))


def test_entry_has_sql_for_all_core_queries():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and set(queries.QUERIES) <= set(entry.queries())
