"""Codecs, scores, converters and rules on small golden cases, whose values are fixed."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import codecs, text
from ledgerline.operators import catalog, convert, estimate, match, models, pages, pools, report, sample, score, synth, validate
from ledgerline.schema import EXAMPLE, FIELDS, RECORD, SCORED_ENTRY, TAGGED_ENTRY
from ledgerline.sources import metadata, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rec(**given):
    return {f: False if f == "is_business" else "" for f in FIELDS} | given


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- functions


@pytest.mark.parametrize("raw,name", [("MCCARTHY", "McCarthy"), ("OBRIEN", "O'Brien"), ("OWENS", "Owens"), ("MACDONALD", "Macdonald"), ("SMITH", "Smith"), ("VON-TRAPP", "Von-Trapp"), ("OCONNOR", "O'Connor"), ("MACEY", "Macey")])
def test_recase(spark, raw, name):
    assert one(spark, text.recase(F.lit(raw))) == name


@pytest.mark.parametrize("value,want", [("x. .", "x."), (" A  b. ", "a b"), (None, ""), ("Tab\tbed..", "tab bed")])
def test_norm(spark, value, want):
    assert one(spark, text.norm(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("value,want", [("dir 1875-76", "1875/76"), ("1850 / 1851 x", "1850/51"), ("for 1917", "1917"), ("none", "")])
def test_parse_year(spark, value, want):
    assert one(spark, text.parse_year(F.lit(value))) == want


def test_clean_occupation(spark):
    for keep in ("grocer", "cabinet maker", "wines & liquors", "boarding house", "drygood store", "shagreen case maker", "tailor."):
        assert one(spark, text.clean_occupation(F.lit(keep))) == keep
    for drop in ("84 Bowery", "", "corner of Broadway", "do", "N/A", "x" * 50):
        assert one(spark, text.clean_occupation(F.lit(drop))) == ""


@pytest.mark.parametrize("name,want", [("nypl_longworth_1818_19_69fdfa80", ("longworth", "1818/19")), ("nypl_elliot_1812_e9592bb0", ("elliot", "1812")), ("nypl_low_buell_bull_1796_2dfca400", ("low", "1796"))])
def test_parse_dir(spark, name, want):
    assert tuple(one(spark, text.parse_dir(F.lit(name)))) == want


@pytest.mark.parametrize("url,kind,ident", [
    ("https://www.loc.gov/item/1/", "loc", "https://www.loc.gov/item/1/"), ("https://archive.org/details/abc?x", "ia", "abc"), ("token", "ia", "token"), ("http://x/y", "iiif", "http://x/y"),
    ("https://digitalcollections.nypl.org/collections/none", None, None), ("4adf9ec0-317a-0134-03ad-00505686a51c", "nypl", "4adf9ec0-317a-0134-03ad-00505686a51c"),
])
def test_detect_source(spark, url, kind, ident):
    got = one(spark, text.detect_source(F.lit(url)))
    assert (got.kind, got.ident) == (kind, ident) and (got.error is None) == (kind is not None)


def test_publisher_slug(spark):
    for raw, slug in (("Trow/Wilson", "trow"), ("Doggett's", "doggett"), ("Hope & Henderson", "hopehenderson"), ("M&B Directory Co.", "mb"), ("R.L. Polk", "polk")):
        assert one(spark, text.publisher_slug(F.lit(raw))) == slug


def test_split_first_comma(spark):
    a, b = text.split_first_comma(F.lit("Nora (wid A, (B, c)) x, h 3"))
    assert (one(spark, a), one(spark, b)) == ("Nora (wid A, (B, c)) x", " h 3")


# ---------------------------------------------------------------- codecs


def test_codecs(spark):
    d = frame(spark, [(rec(name='" Jno \\H', is_business=True, address="5 Main"),)], "r " + RECORD.simpleString())
    pipe = d.select(codecs.to_pipe(F.col("r")).alias("x")).first().x
    assert pipe == '" Jno \\H|True|||||5 Main|'
    block = d.select(codecs.to_yaml(F.col("r")).alias("x")).first().x
    plain, undone = (one(spark, codecs.parse_yaml(F.lit(block), u)) for u in (False, True))
    assert plain.name == '\\" Jno \\\\H' and undone.name == '" Jno \\H' and plain.spouse_name == "" and plain.address == "5 Main"
    assert one(spark, codecs.parse_pipe(F.lit("a | True"))).asDict() == {f: {"name": "a", "is_business": "True"}.get(f, "") for f in FIELDS}
    assert one(spark, codecs.parse_yaml(F.lit("name:\naddress: x\nname: late"))).asDict()["name"] == ""


def test_replies(spark):
    row = "Smith John|False|||clk||12 Pine|34 Elm"
    for reply in (row, f"```\n{row}\n```", f"Sure:\n{row}", f"```text\n{row}\n```"):
        assert one(spark, codecs.parse_response(F.lit(reply))) == row
    assert one(spark, codecs.parse_response(F.lit(""))) == "" and one(spark, codecs.parse_response(F.lit("no pipes here"))) == "no pipes here"
    assert one(spark, codecs.parse_response(F.lit("```yaml\na: 1\n\nb: 2\n```"), "yaml")) == "a: 1\nb: 2"
    reply = 'name: "A"\naddress: "117 Front do"\nname: "A"\naddress: "11'
    assert one(spark, codecs.first_record(F.lit(reply))) == 'name: "A"\naddress: "117 Front do"'
    assert one(spark, codecs.runs_away(F.lit(reply)))
    context = F.struct(F.lit("trow").alias("publisher"), F.lit(None).cast("string").alias("directory_year"))
    assert one(spark, codecs.user_prompt(context, F.lit("Smith"))) == "[publisher=trow; year=?] Smith"


# ---------------------------------------------------------------- scoring


def test_score_of_itself_and_with_blanks(spark):
    gold = frame(spark, [(i, *rec(name=f"N{i}", occupation_role="clk", address="1 a").values()) for i in range(10)], "row_id long, " + RECORD.simpleString()[7:-1])
    same = score.overall(score.zipped(gold, gold)).first()
    assert (same.row_exact_pct, same.macro_f1, same.micro_f1) == (100.0, 1.0, 1.0)
    half = gold.withColumn("occupation_role", F.when(F.col("row_id") % 2 == 0, "").otherwise(F.col("occupation_role")))
    m = {r.field: r for r in score.field_metrics(score.zipped(gold, half)).collect()}
    assert m["occupation_role"].r == 0.5 and m["occupation_role"].p == 1.0 and not m["employer"].applicable
    assert score.overall(score.zipped(gold, half), exclude=("occupation_role",)).first().row_exact_pct == 100.0
    missing = score.overall(score.zipped(gold, gold.where("row_id < 5"))).first()
    assert missing.n == 10 and missing.row_exact_pct == 50.0
    log = score.run_row(score.zipped(gold, half), "m", "g", "p", "2024").first()
    assert log.per_field["occupation_role"].r == 0.5


def test_pivot_keeps_the_last_run(spark):
    log = frame(spark, [(1, "nyu", "gliner-medium", 0.333), (2, "nyu", "flash", 0.71), (3, "ftd", "gliner-multi", 0.25), (4, "nyu", "gliner-medium", 0.41)], "at int, ev string, label string, macro double")
    labels = ["gliner-medium", "flash", "gliner-multi"]
    lines = {r.ev: r.line for r in report.markdown(report.last_wins(log, "ev", "label", ["macro"], F.col("at"), labels), "ev", labels, "macro").collect()}
    assert lines == {"nyu": "| nyu | 0.410 | 0.710 | — |", "ftd": "| ftd | — | — | 0.250 |"}


# ---------------------------------------------------------------- converters


def test_lines_with_carried_surname(spark):
    lines = [
        "Cook Ira M, bkpr G C Christian, rms 802 2d av n.", "Jacob H, lawyer 507 Kasota bldg, r 1318 Mt Curve av.", "James, clk P J Kinnane, b 1607 n 4th.", "James W, b Soldiers' Home.",
        "Mrs Laura W, stenogr Am Bridge Co, b 1016 s e 7th.", "Mary (wid George A), b 1231 s 9th.", "Nora M (wid Joseph), dressmkr flat 8 728 Nicollet av, r same.",
    ]
    d = frame(spark, [("p", k, x) for k, x in enumerate(lines)] + [("q", 0, "ALL CAPS HEAD"), ("q", 1, "Dunn Ada, b 5 Elm st")], "page string, pos int, line string")
    got = [r.record for r in convert.from_lines(d.where("page = 'p'"), surname="Cook").orderBy("pos").collect()]
    assert len(got) == 7 and all(r.name.startswith("Cook ") for r in got)
    assert (got[1].address, got[1].home_address) == ("507 Kasota bldg", "r 1318 Mt Curve av") and got[5].spouse_name == "wid George A"
    assert got[6].occupation_role == "dressmkr" and got[6].address.startswith("flat")
    free = {(r.page, r.pos): r.record.name for r in convert.from_lines(d).collect()}
    assert free["p", 0] == "Cook Ira M" and free["p", 2] == "Cook James" and free["p", 4] == "Cook Mrs Laura W" and free["q", 1] == "Dunn Ada"


def test_scored_entries(spark, tmp_path):
    good = {"complete_entry": "Graham, wid. of Jeremy h. 3 Elm", "directory_year": 1850, "labeled_widow": 1, "labeled_black": "0", "low_entry_caution": 0,
            "labeled_entry": {"subjects": ["Graham Ann"], "occupations": [], "locations": []},
            "corrected_entry": {"subjects": [], "occupations": [{"value": "clk", "score": "20"}], "locations": [{"value": "3 Elm", "labels": ["h"], "score": 30}, {"value": "9 Oak", "label": "h", "score": 30}]}}
    poor = json.loads(json.dumps(good))
    poor["corrected_entry"]["occupations"][0]["score"] = "n/a"
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n" + json.dumps(poor) + "\n\n" + json.dumps(good)[:50] + "\n")
    d, tally = readers.scored_entries(spark, str(tmp_path / "a.json"))
    assert tuple(tally.first()) == (3, 1)
    rows = convert.from_scored(d).orderBy(F.col("drop_reason").isNotNull()).collect()
    assert rows[0].record.spouse_name == "wid Jeremy" and (rows[0].record.address, rows[0].record.home_address) == ("9 Oak", "3 Elm") and rows[1].drop_reason == "score"
    assert rows[0].context.alphabetical_range == "GRA" and SCORED_ENTRY
    assert {r.outcome: r.n for r in convert.drop_counts(convert.from_scored(d)).collect()} == {"kept": 1, "score": 1}


def test_tagged_entries(spark, tmp_path):
    rows = [{"book": 1845, "page": 3, "text_ocr_ref": "Dupont  et Cie, vins", "nested_ner_xml_ref": "<PER>Dupont et <b>Cie</b></PER>, <ACT>vins</ACT>"}, {"book": "x", "text_ocr_ref": "a", "nested_ner_xml_ref": "<PER>A</PER>"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = convert.from_tagged(readers.tagged_entries(spark, str(tmp_path / "a.json"))).orderBy("raw_line").collect()
    assert got[0].record.name == "Dupont et Cie" and got[0].record.is_business and got[0].context.directory_year == "1845" and got[1].drop_reason == "address" and TAGGED_ENTRY


def test_aligned_entries(spark):
    names = ["image", "pos", "canvas_fragment", "name", "address", "is_business", "spouse_name", "race_designation", "occupation_role", "employer", "surname", "given_name", "occupation", "occupant_name", "street_name", "is_advertisement", "alphabetical_range"]
    entry = lambda pos, at, name, address: ("i", pos, f"c#xywh={at},1,1,1", name, address) + ("",) * 12
    e = frame(spark, [entry(0, 1, "Ann Lee", "3 Elm"), entry(1, 3, "Bob Roe", "9 Oak"), entry(2, 99, "No Page", "1 a")], ", ".join(f"{n} {'int' if n == 'pos' else 'string'}" for n in names))
    lines = frame(spark, [("i", k, f"c#xywh={k},1,1,1", t) for k, t in enumerate(["head", "Ann Lee,", "clk 3 Elm", "Bob Roe", "", "9 Oak"])], "image string, pos int, fragment string, text string")
    got = {r.record.name: r.raw_line for r in convert.from_aligned(e, lines).collect()}
    assert got == {"Ann Lee": "Ann Lee, clk 3 Elm", "Bob Roe": "Bob Roe 9 Oak"}


# ---------------------------------------------------------------- catalog


def test_new_rows_and_merge(spark):
    master = frame(spark, [("ia", "a"), ("ia", " b ")], "source string, id string")
    fresh = frame(spark, [(0, "IA", "a"), (1, "ia", "c"), (2, "ia", "c"), (3, "ia", ""), (4, "nypl", "a")], "pos int, source string, id string")
    assert [r.pos for r in catalog.new_rows(fresh, "pos", master).orderBy("pos").collect()] == [1, 4]
    merged, left = catalog.merge_pending(master, fresh, "pos")
    assert merged.count() == 4 and left.count() == 0
    merged, left = catalog.merge_pending(master, fresh.where("pos = 0"), "pos")
    assert merged.count() == 2 and left.count() == 1


def test_enrich_and_backfill(spark):
    rows = frame(spark, [("nypl", "1", "", "", "", "", "n"), ("nypl", "2", "Kept", "1900", "", "", ""), ("nypl", "3", "", "", "", "", "")], "source string, id string, publisher string, year string, borough string, title string, notes string")
    found = frame(spark, [("1", "H. Trow & co", "1850-51", "Brooklyn and Queens", None), ("2", "x", "1910", "Bronx", None), ("3", None, None, None, "timeout")], "id string, publisher_text string, year_text string, title_text string, error string")
    got = {r.id: r for r in catalog.enrich(rows, found, ["id"]).collect()}
    assert (got["1"].publisher, got["1"].year, got["1"].borough) == ("Trow", "1850/51", "") and got["1"].notes.startswith("REVIEW") and got["1"].notes.endswith("n | covers Brooklyn, Queens")
    assert (got["2"].publisher, got["2"].year, got["2"].borough) == ("Kept", "1900", "Bronx") and got["3"].notes == "enrich failed"
    meta = frame(spark, [("a", ["Brooklyn Public Library, Brooklyn Collection"], [], []), ("b", [], [], ["x", "allen_county_lib"])], "id string, contributor array<string>, uploader array<string>, collection array<string>")
    assert {r.id: (r.institution, r.how) for r in catalog.resolve(meta).collect()} == {"a": ("Brooklyn Public Library", "contributor"), "b": ("Allen County Public Library", "collection")}


def test_metadata_shapes(spark):
    v2 = {"label": "L", "sequences": [{"canvases": [{"@id": "c", "width": 9, "height": 8, "label": "p1", "images": [{"resource": {"@id": "i", "service": {"@id": "s/"}}}]}]}], "metadata": [{"label": "Title", "value": ["a", "b"]}]}
    v3 = {"label": {"en": ["L", "M"]}, "items": [{"id": "c", "width": 9, "height": 8, "items": [{"items": [{"body": {"id": "i", "service": [{"id": "s"}]}}]}]}]}
    d = frame(spark, [(2, json.dumps(v2)), (3, json.dumps(v3))], "k int, j string")
    got = {r.k: r for r in metadata.canvases(d, "k", "j").collect()}
    assert all((got[k].canvas, got[k].image, got[k].width) == ("c", "i", 9) for k in (2, 3)) and got[2].service == "s/" and got[3].service == "s"
    meta = {r.k: r for r in metadata.manifest_meta(d, "k", "j").collect()}
    assert meta[3].title == "L M" and meta[2].meta == {"title": "a b"}
    mods = {"nyplAPI": {"response": {"mods": {"titleInfo": [{"title": {"$": "other"}}, {"usage": "primary", "title": {"$": "T"}, "partNumber": {"$": "2"}}], "originInfo": {"publisher": {"$": "Pub"}, "dateIssued": [{"$": "1850"}]}, "subject": {"geographic": {"$": "Queens"}}}}}}
    got = metadata.mods(frame(spark, [("a", json.dumps(mods))], "id string, j string"), "id", "j").first()
    assert (got.publisher_text, got.title_text, got.places, got.year_text) == ("Pub", "T 2", ["Queens"], "1850 T 2")
    search = {"response": {"numFound": 1, "docs": [{"identifier": "x", "title": ["Trow 1850"], "year": 1850}]}}
    assert metadata.search_pages(frame(spark, [(1, json.dumps(search))], "p int, j string"), "p", "j").first().publisher == "Trow"
    loc = {"results": [{"id": "http://www.loc.gov/item/77/", "type": ["Text"], "title": "t"}, {"id": "x", "type": ["image"], "title": "u"}]}
    assert [r.id for r in metadata.congress_results(frame(spark, [(json.dumps(loc),)], "j string"), "j").collect()] == ["77"]


# ---------------------------------------------------------------- joins, windows, selection


def test_containment_ways_agree(spark, monkeypatch):
    docs = frame(spark, [(1, "the brooklyn eagle"), (2, "kings"), (3, None)], "k int, t string")
    pins = frame(spark, [(0, "brook"), (1, "brooklyn"), (2, "kin"), (3, "eagle xx")], "pos int, n string")
    want = {1: "brooklyn", 2: "kin"}
    assert {r.k: r.n for r in match.longest_contained(docs, "k", "t", pins, "n", "pos").collect()} == want
    monkeypatch.setattr(match, "SMALL", 0)
    assert {r.k: r.n for r in match.longest_contained(docs, "k", "t", pins, "n", "pos").collect()} == want


def test_greedy_match(spark):
    r = frame(spark, [("p", 0, "a b c"), ("p", 1, "a b"), ("p", 2, "")], "g string, pos int, t string")
    e = frame(spark, [("p", 0, "a b c d"), ("p", 1, "a b c"), ("q", 2, "a b")], "g string, pos int, t string")
    assert {x.record_pos: x.entry_pos for x in match.greedy_match(r, e, "g", "pos", "t").collect()} == {0: 1, 1: 0, 2: None}


def test_gap(spark):
    d = frame(spark, [("v", i) for i in (0, 1, 5, 40, 41)] + [("w", 0), ("w", 3)] + [("x", None), ("x", 4)], "g string, i int")
    got = sorted((r.g, r.i or -1) for r in pages.after_gap(d, "g", F.col("i")).collect())
    assert got == [("v", 40), ("v", 41), ("x", -1), ("x", 4)]


def test_spread_rule(spark):
    for n in range(1, 12):
        for per in range(1, 6):
            got = [r.k for r in spark.range(1, n + 1).withColumnRenamed("id", "k").where(sample.spread(F.col("k"), F.lit(n), per)).collect()]
            want = [n // 2 + 1] if per == 1 else list(range(1, n + 1)) if n <= per else sorted({round(i * (n - 1) / (per - 1)) + 1 for i in range(per)})
            assert got == want, (n, per)


def test_names_pool(spark):
    e = frame(spark, [("", "Bemmert", "Bernard", "False"), ("", "Alling", "Louis W.", "False"), ("", "Acme", "Laundry", "True"), ("Huelsberg F. D.", "", "", "false")], "name string, surname string, given_name string, is_business string")
    surnames, given = pools.names(e)
    assert {r.term for r in surnames.collect()} == {"Bemmert", "Alling", "Huelsberg"}
    given = {r.term for r in given.collect()}
    assert "Louis" in given and "W" not in given and "Laundry" not in given


def test_occupation_pool(spark):
    blocks = frame(spark, [("name: a\noccupation_role: grocer",), ('occupation_role: "84 Bowery"',), ("occupation_role: cabinet maker\n",), ("occupation_role:\nemployer: x",)], "b string")
    assert {r.term: r["count"] for r in pools.occupations(blocks, "b").collect()} == {"grocer": 1, "cabinet maker": 1}


def test_spans(spark):
    spans = frame(spark, [(1, "person name", "Murphy & Sons", 0.98, 0), (1, "occupation", "grocers", 0.9, 1), (1, "address", "5 Main", 0.88, 2), (1, "address", "6 Main", 0.88, 3)], "k int, label string, text string, score double, pos int")
    got = pages.assembled(spans, "k").select(codecs.to_pipe(F.struct(*FIELDS)).alias("x")).first().x
    assert got == "Murphy & Sons|True|||grocers||5 Main|"


# ---------------------------------------------------------------- rules, models, generator, files


def test_validate_lines(spark):
    good = {"raw_line": "Lee Ann, clk, 3 Elm st", "context": {"publisher": "trow", "alphabetical_range": "LEE", "directory_year": "1850/51", "image": "i"}, "record": rec(name="Lee Ann", occupation_role="clk", address="3 Elm st")}
    bad = {"raw_line": "x", "context": {"publisher": "who", "dialect": "d", "directory_year": "50"}, "record": rec(name="", is_business="no", home_address="h 3 Elm", extra="")}
    del bad["record"]["employer"]
    d = frame(spark, [("f", 1, json.dumps(good)), ("f", 2, json.dumps(bad)), ("f", 3, "{oops"), ("f", 4, "  "), ("f", 5, '{"raw_line": ""}')], "file string, line int, value string")
    found = validate.check_lines(d)
    got = {(r.line, r.rule) for r in found.collect()}
    assert not [x for x in got if x[0] == 1]
    assert {"empty_name", "business_not_boolean", "missing_field", "unknown_field", "home_mark", "retired_context", "missing_context", "unknown_publisher", "odd_year", "home_without_address"} <= {r for k, r in got if k == 2}
    assert (3, "invalid_json") in got and (5, "missing_part") in got and validate.failed(found)


def test_models_keep_places(spark):
    rows = frame(spark, [(i, f"t{i}") for i in range(6)], "row_id long, text string")

    def load():
        def model(part):
            if any(r["text"] == "t3" for r in part):
                raise ValueError
            return [r["text"].upper() for r in part]

        return model

    got = {r.row_id: (r.prediction, r.status) for r in models.predict(rows.coalesce(1), load, wait=0, tries=2).collect()}
    assert got[3] == ("", "failed") and got[2] == ("T2", "ok")


def test_generator(spark):
    a = synth.generate(spark, 400, seed=3).orderBy("row_id").collect()
    b = synth.generate(spark.newSession(), 400, seed=3).repartition(7).orderBy("row_id").collect()
    assert a == b and len(a) == 400
    assert all(r.raw_line == r.clean_line for r in synth.generate(spark, 50, noise=0.0).collect())
    s = {r.feature: r.n / r.rows for r in synth.statistics(synth.generate(spark, 3000)).collect()}
    assert 0.2 < s["noisy"] < 0.36 and 0.01 < s["business"] < 0.08 and s["two_addresses"] > 0.1


def test_estimate(spark):
    e = {(r["size"], r.gpu): r for r in estimate.estimate(estimate.grid(spark), F.lit(100_000), F.lit(3.0)).collect()}
    assert e["0.8B", "a100"].batch == 64 and e["4B", "l40s"].batch < 64 and e["0.8B", "a100"].jobs == 1


def test_files_round_trip(spark, tmp_path):
    d = frame(spark, [("a", ("p", "", "1850", None, None, None, None), tuple(rec(name="A").values()))], EXAMPLE)
    sinks.examples(d, str(tmp_path / "e"))
    assert readers.records(spark, str(tmp_path / "e")).first().name == "A"
    preds = frame(spark, [(k, *rec(name=f"n{k}").values()) for k in (1, 0, 2)], "row_id long, " + RECORD.simpleString()[7:-1])
    for target in ("pipe", "yaml"):
        sinks.predictions(preds, str(tmp_path / target), target)
        part = next(str(p) for p in (tmp_path / target).iterdir() if p.name.startswith("part"))
        assert [r.name for r in readers.predictions(spark, part, target).orderBy("row_id").collect()] == ["n0", "n1", "n2"]
    sinks.pool(frame(spark, [("a", 1), ("b", 5)], "term string, count long"), frame(spark, [("a", 9)], "term string, count long"), str(tmp_path / "pool"))
    assert {r.term: r["count"] for r in readers.pool(spark, str(tmp_path / "pool")).collect()} == {"a": 10, "b": 5}
