"""Queries of converters, rules, the catalog, pools and pages over the driver's tables, each beside its SQL.

The reference's inputs (label sets, metadata documents, page files) are built from rows of those tables, by the class that a
key falls in, so that every branch of an operator comes up; the SQL says for each class what has to come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, text
from ..operators import catalog, convert, match, pages, pools, report, sample, score, synth, validate
from ..schema import CATALOG, FIELDS, SCORED_ENTRY
from ..sources import metadata, readers, sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark: SparkSession, d: str, *named: str) -> DataFrame:
    """Customers as k, name and SQL expressions ``expression AS column``."""
    return read(spark, d, "customer").selectExpr("*", "c_custkey AS k").selectExpr("*", *named)


def by_class(k: str, of: int, texts: dict[int, str], other: str = "''") -> str:
    """SQL: a text by the class that k falls in."""
    return f"CASE {k} % {of} {' '.join(f'WHEN {c} THEN {t}' for c, t in texts.items())} ELSE {other} END"


# ---------------------------------------------------------------- rules

_LINE = "c_name || ', clerk, ' || n || ' Elm st'"
_VALIDATED = f"""
WITH c AS (SELECT c_custkey AS line, c_custkey % 20 AS cls, c_name, (c_custkey % 900 + 1)::VARCHAR AS n FROM customer),
f AS (
  SELECT line, cls, unnest(CASE cls
    WHEN 1 THEN [{{'s': 'error', 'r': 'invalid_json', 'd': NULL}}] WHEN 2 THEN [{{'s': 'error', 'r': 'missing_part', 'd': 'record'}}]
    WHEN 3 THEN [{{'s': 'error', 'r': 'missing_part', 'd': 'raw_line'}}, {{'s': 'error', 'r': 'missing_part', 'd': 'context'}}]
    WHEN 4 THEN [{{'s': 'error', 'r': 'missing_field', 'd': 'employer'}}, {{'s': 'error', 'r': 'unknown_field', 'd': 'age'}}]
    WHEN 5 THEN [{{'s': 'error', 'r': 'business_not_boolean', 'd': 'STRING'}}] WHEN 6 THEN [{{'s': 'error', 'r': 'empty_name', 'd': NULL}}]
    WHEN 7 THEN [{{'s': 'error', 'r': 'bar_or_newline', 'd': 'occupation_role'}}] WHEN 8 THEN [{{'s': 'error', 'r': 'bar_or_newline', 'd': 'address'}}]
    WHEN 9 THEN [{{'s': 'warning', 'r': 'token_drift', 'd': 'occupation_role: cooper'}}] WHEN 10 THEN [{{'s': 'warning', 'r': 'occupation_is_address', 'd': 'clerk ' || n || ' Elm'}}]
    WHEN 11 THEN [{{'s': 'warning', 'r': 'odd_address', 'd': 'Elm'}}] WHEN 12 THEN [{{'s': 'warning', 'r': 'home_without_address', 'd': n || ' Elm st'}}]
    WHEN 13 THEN [{{'s': 'error', 'r': 'home_mark', 'd': 'h ' || n}}] WHEN 14 THEN [{{'s': 'warning', 'r': 'home_mark_unsure', 'd': 'r' || n}}]
    WHEN 15 THEN [{{'s': 'warning', 'r': 'firm_not_business', 'd': c_name || ' & Co'}}]
    WHEN 16 THEN [{{'s': 'error', 'r': 'missing_context', 'd': 'image'}}, {{'s': 'error', 'r': 'retired_context', 'd': 'dialect'}}]
    WHEN 17 THEN [{{'s': 'warning', 'r': 'odd_year', 'd': '50'}}] WHEN 18 THEN [{{'s': 'warning', 'r': 'unknown_publisher', 'd': 'who'}}]
    ELSE [] END) AS x FROM c),
findings AS (SELECT line, x.s AS severity, x.r AS rule, x.d AS detail FROM f)
"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """line and value: examples as JSON, of twenty classes, most with one fault."""
    c = customers(spark, d, "k % 20 AS cls", "cast(k % 900 + 1 AS string) AS n")
    is_ = lambda *cls: F.col("cls").isin(*cls)
    name = F.when(is_(6), " ").when(is_(15), F.concat("c_name", F.lit(" & Co"))).otherwise(F.col("c_name"))
    job = F.when(is_(7), "clerk|x").when(is_(9), "cooper").when(is_(10), F.concat(F.lit("clerk "), "n", F.lit(" Elm"))).otherwise("clerk")
    address = F.when(is_(8), F.concat("n", F.lit("\nElm st"))).when(is_(11), "Elm").when(is_(12), "").otherwise(F.concat("n", F.lit(" Elm st")))
    home = F.when(is_(12), F.concat("n", F.lit(" Elm st"))).when(is_(13), F.concat(F.lit("h "), "n")).when(is_(14), F.concat(F.lit("r"), "n")).otherwise("")
    record = F.struct(
        name.alias("name"), F.lit(False).alias("is_business"), F.lit("").alias("spouse_name"), F.lit("").alias("race_designation"), job.alias("occupation_role"),
        F.when(~is_(4), "").alias("employer"), address.alias("address"), home.alias("home_address"), F.when(is_(4), "40").alias("age"),
    )
    context = F.struct(
        F.when(is_(18), "who").otherwise("trow").alias("publisher"), F.lit("CUS").alias("alphabetical_range"), F.when(is_(17), "50").otherwise("1850/51").alias("directory_year"),
        F.when(~is_(16), "i").alias("image"), F.when(is_(16), "x").alias("dialect"),
    )
    line = F.concat("c_name", F.when(is_(15), " & Co").otherwise(""), F.lit(", clerk, "), "n", F.lit(" Elm st"))
    whole = F.to_json(F.struct(F.when(~is_(3), line).alias("raw_line"), F.when(~is_(3), context).alias("context"), F.when(~is_(2), record).alias("record")))
    value = F.when(is_(1), "{oops").when(is_(19), "   ").when(is_(5), F.replace(whole, F.lit('"is_business":false'), F.lit('"is_business":"no"'))).otherwise(whole)
    return c.select(F.lit("f").alias("file"), F.col("k").alias("line"), value.alias("value"))


@query(_VALIDATED + "SELECT line, severity, rule, detail FROM findings")
def validate_lines(spark: SparkSession, d: str) -> DataFrame:
    return validate.check_lines(_examples(spark, d)).select("line", "severity", "rule", "detail")


@query(_VALIDATED + "SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(validate.check_lines(_examples(spark, d)))


@query(_VALIDATED + "SELECT line, severity, rule FROM findings ORDER BY severity, line, rule LIMIT 200")
def findings_shown(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 findings, as the report shows them."""
    return validate.shown(validate.check_lines(_examples(spark, d)), "file", "line").select("line", "severity", "rule")


@query("""WITH t AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
    b AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))
  SELECT doc_id, len(list_filter(b.w, lambda x: length(x) > 1 AND NOT list_contains(t.w, x)))::INT AS n_drift FROM t, b""")
def token_drift(spark: SparkSession, d: str) -> DataFrame:
    """How many words of the first benchmark passage each document lacks."""
    first = read(spark, d, "benchmark").agg(F.min_by("text", "item_id").alias("value"))  # one row
    docs = read(spark, d, "documents").join(F.broadcast(first), F.lit(True))
    return docs.select("doc_id", F.size(validate.drift(F.col("text"), F.col("value"))).alias("n_drift"))


@query("""WITH i AS (SELECT c_nationkey AS image, count(*) AS n, count_if(c_acctbal < 0)::BIGINT AS firms FROM customer GROUP BY c_nationkey)
  SELECT image, n, firms, round(firms / n, 6) AS ratio, n < 60 AS thin FROM i""")
def image_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines an image, thin images and the share of firms; nations as images."""
    c = customers(spark, d, "c_nationkey AS image", "c_acctbal < 0 AS is_business")
    thin = validate.thin(c, "image", 60).select("image", F.lit(True).alias("thin"))
    per = c.groupBy("image").agg(F.count("*").alias("n"), F.count_if("is_business").alias("firms")).join(thin, "image", "left")
    return per.select("image", "n", "firms", F.round(F.col("firms") / F.col("n"), 6).alias("ratio"), F.coalesce("thin", F.lit(False)).alias("thin"))


# ---------------------------------------------------------------- converters

_SCORED_SQL = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 12 AS cls, 'Cust' || c_custkey || ' Ann' AS who FROM customer WHERE c_custkey % 50 <> 49),
e AS (SELECT *, CASE cls WHEN 8 THEN who || ', wid. of Jeremy h. 3 Elm' WHEN 9 THEN who || ', widow, 3 Elm' WHEN 10 THEN who || ' colored, 3 Elm' ELSE who || ', 3 Elm' END AS raw_line,
  CASE cls WHEN 11 THEN 'SMITH' || k || ' & Co' WHEN 4 THEN '' ELSE who END AS name FROM c),
out AS (SELECT k, raw_line, name, cls = 11 AS is_business, CASE cls WHEN 2 THEN 'clk' ELSE 'clk, grocer' END AS occupation,
  CASE WHEN cls = 5 THEN '' WHEN cls = 6 THEN '3 Elm' ELSE '9 Oak' END AS address, CASE WHEN cls IN (5, 6) THEN '' ELSE '3 Elm' END AS home,
  CASE cls WHEN 8 THEN 'wid Jeremy' WHEN 9 THEN 'wid' ELSE '' END AS spouse, CASE cls WHEN 10 THEN 'colored' ELSE '' END AS race,
  CASE cls WHEN 11 THEN 'SMI' WHEN 4 THEN '' ELSE 'CUS' END AS range, CASE cls WHEN 1 THEN 'caution' WHEN 2 THEN 'score' WHEN 3 THEN 'score' WHEN 4 THEN 'name' WHEN 5 THEN 'address' END AS drop_reason FROM e)
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON, one in fifty cut off, read and converted."""
    c = customers(spark, d, "k % 12 AS cls", "concat('Cust', k, ' Ann') AS who")
    is_ = lambda *cls: F.col("cls").isin(*cls)
    raw = F.concat("who", F.when(is_(8), ", wid. of Jeremy h. 3 Elm").when(is_(9), ", widow, 3 Elm").when(is_(10), " colored, 3 Elm").otherwise(", 3 Elm"))
    names = F.when(is_(4), F.array().cast("array<string>")).when(is_(11), F.array(F.concat(F.lit("SMITH"), "k", F.lit(" & Co")))).otherwise(F.array("who"))
    place = lambda value, marks, single: F.struct(F.lit(value).alias("value"), marks.alias("labels"), single.alias("label"), F.lit("30").alias("score"))
    none, home = F.lit(None), F.array(F.lit("h"))
    first = place("3 Elm", home, none.cast("string"))
    second = place("9 Oak", F.when(is_(7), home), F.when(~is_(7), F.lit("b")))
    places = F.when(is_(5), F.array().cast("array<struct<value:string,labels:array<string>,label:string,score:string>>")).when(is_(6), F.array(first)).otherwise(F.array(first, second))
    job = lambda value, points: F.struct(F.lit(value).alias("value"), points.alias("score"))
    jobs = F.when(is_(2), F.array(job("clk", F.lit("n/a")))).otherwise(F.array(job("clk", F.when(is_(3), "14").otherwise("15")), job("grocer", F.lit("99"))))
    entry = F.struct(
        raw.alias("complete_entry"), F.lit(1850).alias("directory_year"), F.when(is_(1), 1).otherwise(0).alias("low_entry_caution"), F.when(is_(8, 9), "1").otherwise("0").alias("labeled_widow"),
        F.when(is_(10), 1).otherwise(0).alias("labeled_black"), F.struct(names.alias("subjects")).alias("labeled_entry"),
        F.struct(F.array().cast("array<string>").alias("subjects"), jobs.alias("occupations"), places.alias("locations")).alias("corrected_entry"),
    )
    whole = F.to_json(entry)
    lines = c.select("k", F.when(F.col("k") % 50 == 49, F.left(whole, F.length(whole) - 5)).otherwise(whole).alias("value"))
    return readers.tolerant_json(lines, "value", SCORED_ENTRY)


@query(_SCORED_SQL + "SELECT raw_line, name, is_business, occupation, address, home, spouse, race, range, drop_reason FROM out")
def scored_entries(spark: SparkSession, d: str) -> DataFrame:
    found = convert.from_scored(_scored(spark, d).where("_p._corrupt is null").select("_p.*"))
    r = "record"
    return found.select("raw_line", f"{r}.name", f"{r}.is_business", F.col(f"{r}.occupation_role").alias("occupation"), f"{r}.address", F.col(f"{r}.home_address").alias("home"), F.col(f"{r}.spouse_name").alias("spouse"), F.col(f"{r}.race_designation").alias("race"), F.col("context.alphabetical_range").alias("range"), "drop_reason")


@query(_SCORED_SQL + "SELECT coalesce(drop_reason, 'kept') AS outcome, count(*) AS n FROM out GROUP BY ALL UNION ALL SELECT 'broken', count(*) FROM customer WHERE c_custkey % 50 = 49")
def scored_drop_counts(spark: SparkSession, d: str) -> DataFrame:
    parsed = _scored(spark, d)
    kept = convert.drop_counts(convert.from_scored(parsed.where("_p._corrupt is null").select("_p.*")))
    return kept.unionByName(readers.corrupt_tally(parsed).select(F.lit("broken").alias("outcome"), F.col("bad").alias("n")))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS cls FROM customer)
  SELECT CASE cls WHEN 4 THEN '' ELSE 'Line ' || k END AS raw_line, CASE cls WHEN 1 THEN 'Dupont' || k || ' et Cie' WHEN 3 THEN '' WHEN 5 THEN '' ELSE 'Dupont' || k || ' Jean' END AS name, cls = 1 AS is_business,
    CASE WHEN cls IN (3, 6) THEN '' ELSE 'vins, eaux' END AS job, CASE WHEN cls IN (3, 6) THEN '' ELSE 'rue X; 5' END AS address, k::INT AS page,
    CASE cls WHEN 2 THEN 'invalid' WHEN 3 THEN 'empty' WHEN 4 THEN 'empty' WHEN 5 THEN 'name' WHEN 6 THEN 'address' END AS drop_reason FROM c""")
def tagged_entries(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d, "k % 7 AS cls")
    is_ = lambda *cls: F.col("cls").isin(*cls)
    person = F.when(is_(5), "").otherwise(F.concat(F.lit("<PER>Dupont"), "k", F.when(is_(1), " et <b>Cie</b>").otherwise("  Jean"), F.lit("</PER>")))
    rest = F.when(is_(6), "").otherwise("<ACT>vins</ACT>, <ACT>eaux</ACT> <SPAT>rue X</SPAT> <SPAT>5</SPAT>")
    entries = c.select(
        F.lit("1845").alias("book"), F.col("k").cast("int").alias("page"), F.when(is_(4), "").otherwise(F.concat(F.lit("Line \t "), "k")).alias("text_ocr_ref"),
        F.when(is_(3), "").otherwise(F.concat(person, rest)).alias("nested_ner_xml_ref"), F.when(is_(2), False).when(is_(0), True).alias("has_valid_ner_xml_ref"),
    )
    found = convert.from_tagged(entries)
    return found.select("raw_line", "record.name", "record.is_business", F.col("record.occupation_role").alias("job"), "record.address", "context.page", "drop_reason")


@query("""WITH c AS (SELECT c_nationkey AS page, c_custkey AS k, c_custkey % 8 AS cls FROM customer WHERE c_custkey % 8 NOT IN (2, 7)),
    s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) = 1 OR cls IN (0, 4, 6) AS starts,
      CASE cls WHEN 0 THEN 'Sur' || k WHEN 1 THEN 'Mary' WHEN 3 THEN 'J' WHEN 4 THEN 'Nolan' WHEN 5 THEN 'Laura' WHEN 6 THEN 'Acme' || k END AS head FROM c),
    h AS (SELECT *, last_value(CASE WHEN starts THEN head END IGNORE NULLS) OVER (PARTITION BY page ORDER BY k) AS surname FROM s)
  SELECT page, k, CASE cls WHEN 0 THEN surname || ' John' WHEN 6 THEN surname || ' & Co' WHEN 5 THEN surname || ' Mrs' || CASE WHEN starts THEN '' ELSE ' Laura' END
      ELSE surname || CASE WHEN starts THEN '' ELSE ' ' || head END END AS name,
    cls = 6 AS is_business, CASE cls WHEN 1 THEN 'wid George' ELSE '' END AS spouse, CASE cls WHEN 0 THEN 'clerk' WHEN 3 THEN 'lab' WHEN 5 THEN 'bkpr' WHEN 6 THEN 'grocers' ELSE '' END AS job,
    CASE cls WHEN 5 THEN 'Acme Bridge Co' ELSE '' END AS employer, CASE cls WHEN 0 THEN '12 Pine st' WHEN 1 THEN 'b 12 s 9th' WHEN 3 THEN 'r 5 Oak av' WHEN 5 THEN 'b 10 n 4th' WHEN 6 THEN '7 Main st' END AS address,
    CASE cls WHEN 0 THEN 'h 34 Elm' ELSE '' END AS home FROM h WHERE cls <> 4""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages in order: surnames carried forward, headings left out, lines without address dropped after they set the surname."""
    lines = {0: "concat('Sur', k, ' John, clerk 12 Pine st, h 34 Elm')", 1: "'Mary (wid George), b 12 s 9th.'", 2: "'ALL CAPS HEADING'", 3: "'J, lab, r 5 Oak av'", 4: "'Nolan Kate, teacher'", 5: "'Mrs Laura, bkpr Acme Bridge Co, b 10 n 4th.'", 6: "concat('Acme', k, ' & Co, grocers, 7 Main st')", 7: "'12 - 14 - 16'"}
    c = customers(spark, d, "c_nationkey AS page", f"{by_class('k', 8, lines)} AS line")
    found = convert.from_lines(c.select("page", "k", "line"), "page", "k", "line")
    r = F.col("record")
    return found.select("page", "k", r["name"].alias("name"), r["is_business"].alias("is_business"), r["spouse_name"].alias("spouse"), r["occupation_role"].alias("job"), r["employer"].alias("employer"), r["address"].alias("address"), r["home_address"].alias("home"))


_ALIGNED_SQL = """
WITH c AS (SELECT c_nationkey AS image, c_custkey AS k, c_custkey % 7 AS cls, (c_custkey % 90 + 1) || ' Elm st' AS place FROM customer),
l AS (SELECT image, k, cls, 2 * k AS pos, 'Cust' || k || ', clerk,' AS t FROM c UNION ALL SELECT image, k, cls, 2 * k + 1, place FROM c),
o AS (SELECT *, last_value(CASE WHEN cls NOT IN (3, 4) AND pos % 2 = 0 THEN k END IGNORE NULLS) OVER (PARTITION BY image ORDER BY pos) AS owner FROM l),
texts AS (SELECT image, owner, string_agg(t, ' ' ORDER BY pos) AS raw_line FROM o WHERE owner IS NOT NULL GROUP BY ALL)
"""


@query(_ALIGNED_SQL + "SELECT k AS pos, texts.image, raw_line, CASE cls WHEN 5 THEN 'Cust ' || k ELSE 'Cust' || k END AS name, cls = 1 AS is_business, place AS address, CASE cls WHEN 5 THEN 'old clerk' ELSE 'clerk' END AS job FROM texts JOIN c ON owner = k WHERE cls <> 6")
def aligned_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries and lines of pages, of both versions of the table: advertisements and unknown places own no lines."""
    c = customers(spark, d, "c_nationkey AS image", "k % 7 AS cls", "concat(k % 90 + 1, ' Elm st') AS at")
    is_ = lambda *cls: F.col("cls").isin(*cls)
    empty = [F.lit("").alias(x) for x in ("spouse_name", "race_designation", "employer", "occupant_name", "street_name", "alphabetical_range")]
    entries = c.select(
        "image", F.col("k").alias("pos"), F.when(is_(4), F.concat(F.lit("c#xywh=9,9,9."), "k")).otherwise(F.concat(F.lit("c#xywh="), "k", F.lit(",1,1,1"))).alias("canvas_fragment"),
        F.when(is_(5), "").otherwise(F.concat(F.lit("Cust"), "k")).alias("name"), F.when(is_(5), "Cust").alias("surname"), F.when(is_(5), F.col("k").cast("string")).alias("given_name"),
        F.when(is_(6), "99 Nowhere").otherwise(F.col("at")).alias("address"), F.when(is_(1), " YES ").otherwise("no").alias("is_business"), F.when(is_(5), "").otherwise("clerk").alias("occupation_role"),
        F.when(is_(5), "old clerk").alias("occupation"), F.when(is_(3), "true").otherwise("").alias("is_advertisement"), *empty,
    )
    lines = c.select("image", (2 * F.col("k")).alias("pos"), F.concat(F.lit("c#xywh="), "k", F.lit(",1,1,1")).alias("fragment"), F.concat(F.lit("Cust"), "k", F.lit(", clerk,")).alias("text"))
    lines = lines.unionByName(c.select("image", (2 * F.col("k") + 1).alias("pos"), F.lit("plain").alias("fragment"), F.col("at").alias("text")))
    found = convert.from_aligned(entries, lines)
    return found.select("pos", "context.image", "raw_line", "record.name", "record.is_business", "record.address", F.col("record.occupation_role").alias("job"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS t FROM customer)
  SELECT t AS raw_line, CASE WHEN k % 3 = 0 THEN 'lain' ELSE 'trow' END AS publisher, '1850' AS year, '|False||||||' AS pipe FROM c""")
def pseudo_gold(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d, "CASE WHEN k % 3 = 0 THEN 'lain' WHEN k % 3 = 1 THEN ' ' END AS publisher")
    return convert.pseudo_gold(c, "c_name").select("raw_line", "context.publisher", F.col("context.directory_year").alias("year"), codecs.to_pipe(F.col("record")).alias("pipe"))


_TRUTHS = {0: "'\"is_business\": true'", 1: "'\"is_business\": \"false\"'", 2: "'\"is_business\": \"\"'", 3: "'\"is_business\": 0'", 4: "'\"is_business\": 2'", 5: "'\"is_business\": null'", 6: "'\"age\": 1'"}


@query("SELECT c_custkey AS k, c_name || '|' || CASE WHEN c_custkey % 7 IN (0, 1, 4) THEN 'True' ELSE 'False' END || '||||' || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END || '||' AS pipe FROM customer")
def imported_records(spark: SparkSession, d: str) -> DataFrame:
    """Records from an editor's file: fields may lack, be null or of another type."""
    c = customers(spark, d, f"concat('{{\"name\": \"', c_name, '\", ', {by_class('k', 7, _TRUTHS)}, CASE WHEN k % 2 = 0 THEN ', \"employer\": \"x\"' ELSE ', \"employer\": null' END, '}}') AS j")
    return c.select("k", codecs.to_pipe(convert.imported_record(F.try_parse_json("j"))).alias("pipe"))


@query("""SELECT 'line ' || c_custkey AS raw_line, c_name || '|' || CASE WHEN c_custkey % 4 = 1 THEN 'True' ELSE 'False' END || '|||clerk|||' AS pipe FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 2""")
def editor_export(spark: SparkSession, d: str) -> DataFrame:
    """Edited entries: skipped ones and those without a name don't come out, texts are trimmed."""
    record = {f: F.lit("") for f in FIELDS} | {"name": F.when(F.col("k") % 4 == 2, " ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("\t"))), "is_business": F.when(F.col("k") % 4 == 1, True), "occupation_role": F.lit(" clerk ")}
    c = customers(spark, d).select(F.concat(F.lit(" line "), "k", F.lit("\n")).alias("raw_line"), F.lit(1).alias("context"), F.when(F.col("k") % 5 == 0, True).alias("skipped"), F.struct(*[v.alias(f) for f, v in record.items()]).alias("record"))
    return sinks.editor_export(c).select("raw_line", codecs.to_pipe(F.col("record")).alias("pipe"))


@query("""SELECT 'f' || c_custkey AS file, '{"image_width":100,"image_height":50,"lines":[{"bbox":[1,2,3,4],"text":"' || c_name || '","confidence":0.5},{"bbox":[1,2,3,4],"confidence":0.25}]}' AS json,
    c_name || chr(10) AS text, '{"k":' || c_custkey || ',"c_name":"' || c_name || '"}' AS payload FROM customer""")
def page_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Page readings as JSON and plain text, and what an editor is fed with."""
    box = F.array(*[F.lit(x) for x in (1, 2, 3, 4)])
    line = lambda t, c: F.struct(box.alias("bbox"), t.alias("text"), F.lit(c).alias("confidence"))
    c = customers(spark, d).select("k", "c_name", F.concat(F.lit("f"), "k").alias("file"), F.lit(100).alias("image_width"), F.lit(50).alias("image_height"), F.array(line(F.col("c_name"), 0.5), line(F.lit(None).cast("string"), 0.25)).alias("lines"))
    payload = sinks.editor_payload(c, "k", "c_name").select(F.get_json_object("payload", "$.k").cast("long").alias("k"), "payload")
    return sinks.page_ocr(c).join(c.select("k", "file"), "file").join(payload, "k").drop("k")


# ---------------------------------------------------------------- text functions


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS t, c_custkey % 6 AS s FROM customer)
  SELECT k, 'a, b' AS marks, CASE s WHEN 0 THEN 1.5 ELSE 0 END::DOUBLE AS number, s = 1 AS firm_tagged, s IN (1, 2) AS firm_lines, CASE s WHEN 3 THEN '12.5,1,2,3' END AS box,
    CASE s WHEN 4 THEN 'low' ELSE '' END AS publisher, CASE s WHEN 4 THEN '1796/97' ELSE '' END AS year, CASE s WHEN 0 THEN 'trow' WHEN 1 THEN 'polk' ELSE 'hopehenderson' END AS slug,
    CASE WHEN s < 3 THEN 'Nora (wid A, (B)) x' ELSE 'none' END AS head, CASE WHEN s < 3 THEN ' h 3' ELSE '' END AS rest, round(CASE s WHEN 5 THEN 0 ELSE 0.25 END, 6)::DOUBLE AS likeness,
    s IN (0, 1, 2) AS truthy, s IN (0, 1, 2, 3) AS truthy_short, s IN (1, 2, 3) AS noise FROM c""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    cases = {
        "num": {0: "' 1.5'", 1: "'(S)'", 2: "'x'"}, "firm": {1: "'A et Cie'", 2: "'estate of B'"}, "frag": {3: "'c#xywh=12.5,1,2,3'"}, "dir": {4: "'nypl_low_buell_1796_97_2dfca400'", 5: "'nypl_low'"},
        "pub": {0: "'Trow/Wilson'", 1: "'R.L. Polk Co.'"}, "line": {0: "'Nora (wid A, (B)) x, h 3'", 1: "'Nora (wid A, (B)) x, h 3'", 2: "'Nora (wid A, (B)) x, h 3'"}, "yes": {0: "' TRUE '", 1: "'1'", 2: "'yes'", 3: "'T'"}, "page": {1: "'abc'", 2: "'ABC DEF'", 3: "'XIV. 12-13'"},
    }
    other = {"pub": "'Hope & Henderson'", "line": "'none'", "page": "'An entry, h 3'"}
    c = customers(spark, d, *[f"{by_class('k', 6, v, other.get(n, chr(39) * 2))} AS {n}" for n, v in cases.items()])
    head, rest = text.split_first_comma(F.col("line"))
    words = text.jaccard(text.tokens(F.lit("a1 b2 c3")), F.when(F.col("k") % 6 == 5, text.tokens(F.lit(""))).otherwise(text.tokens(F.lit("C3 d4"))))
    volume = text.parse_dir(F.col("dir"))
    return c.select(
        "k", text.squeeze_marks(F.lit(" ,a,   b .")).alias("marks"), text.safe_double(text.trim(F.col("num"))).alias("number"), text.looks_firm_tagged(F.col("firm")).alias("firm_tagged"),
        (text.looks_firm(F.col("firm")) | text.looks_firm_tagged(F.col("firm"))).alias("firm_lines"), text.xywh(F.col("frag")).alias("box"), volume["publisher"].alias("publisher"), volume["year"].alias("year"),
        text.publisher_slug(F.col("pub")).alias("slug"), head.alias("head"), rest.alias("rest"), F.round(words, 6).alias("likeness"), text.truthy(F.col("yes")).alias("truthy"),
        text.truthy(F.col("yes"), short=True).alias("truthy_short"), text.is_noise(F.col("page")).alias("noise"),
    )


@query("""SELECT c_custkey AS k, 'system:s|user:[publisher=?; year=' || c_custkey || '] ' || c_name || '|assistant:' || c_mktsegment AS messages FROM customer""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    context = F.struct(F.lit(None).cast("string").alias("publisher"), F.col("k").cast("string").alias("directory_year"))
    turns = codecs.messages(F.lit("s"), codecs.user_prompt(context, F.col("c_name")), F.col("c_mktsegment"))
    return customers(spark, d).select("k", F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|").alias("messages"))


# ---------------------------------------------------------------- pools


@query("""WITH e AS (SELECT 'Sur' || c_custkey % 50 AS s, CASE c_custkey % 4 WHEN 0 THEN ['Louis'] WHEN 1 THEN ['Ann'] WHEN 2 THEN [] ELSE [] END AS g, c_custkey % 5 = 4 AS whole FROM customer WHERE c_custkey % 10 <> 0),
    t AS (SELECT 'surname' AS pool, s AS term FROM e UNION ALL SELECT 'given', unnest(CASE WHEN whole THEN ['Mary'] ELSE g END) FROM e)
  SELECT pool, term, count(*) AS count FROM t GROUP BY ALL""")
def name_pools(spark: SparkSession, d: str) -> DataFrame:
    """Entries of both versions; firms, initials and tokens with digits don't count."""
    whole = F.col("k") % 5 == 4
    given = F.when(F.col("k") % 4 == 0, "Louis W.").when(F.col("k") % 4 == 1, "Ann").when(F.col("k") % 4 == 2, "X2").otherwise("J.")
    sur = F.concat(F.lit("Sur"), (F.col("k") % 50).cast("string"))
    e = customers(spark, d).select(F.when(whole, F.concat(sur, F.lit(" Mary Q."))).otherwise("").alias("name"), F.when(whole, "").otherwise(sur).alias("surname"), F.when(whole, "").otherwise(given).alias("given_name"), F.when(F.col("k") % 10 == 0, "T").otherwise("no").alias("is_business"))
    e = e.withColumns({c: F.translate(c, "0123456789", "abcdefghij") for c in ("name", "surname")})
    surnames, givens = pools.names(e)
    back = F.translate("term", "abcdefghij", "0123456789")
    surnames = surnames.withColumn("term", F.concat(F.lit("Sur"), F.substr(back, F.lit(4))))
    return surnames.select(F.lit("surname").alias("pool"), "*").unionByName(givens.select(F.lit("given").alias("pool"), "*"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'MC' || upper(c_mktsegment) WHEN 1 THEN 'OBRIEN' WHEN 2 THEN 'VON-' || upper(c_mktsegment) WHEN 3 THEN 'All Other Names' ELSE upper(c_mktsegment) END AS n,
      CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE (c_custkey * 7919) % 100003 END AS w, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE c_custkey % 100 END AS h, c_custkey % 60 AS a, c_mktsegment AS s FROM customer)
  SELECT CASE k % 5 WHEN 0 THEN 'Mc' WHEN 2 THEN 'Von-' ELSE '' END || CASE k % 5 WHEN 1 THEN 'O''Brien' ELSE upper(s[1]) || lower(s[2:]) END AS term, w AS count
  FROM (SELECT * FROM c WHERE k % 5 <> 3 AND w > 0 AND h < 50 AND a < 50 ORDER BY w DESC, k LIMIT 100)""")
def census_pool(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent surnames of a census table, whose suppressed figures are '(S)'."""
    names = {0: "concat('MC', upper(c_mktsegment))", 1: "'OBRIEN'", 2: "concat('VON-', upper(c_mktsegment))", 3: "'All Other Names '"}
    c = customers(spark, d, f"{by_class('k', 5, names, 'upper(c_mktsegment)')} AS name", "CASE WHEN k % 11 = 0 THEN '(S)' ELSE cast((k * 7919) % 100003 AS string) END AS count", "CASE WHEN k % 13 = 0 THEN '(S)' ELSE cast(k % 100 AS string) END AS pcthispanic", "cast(k % 60 AS string) AS pctapi")
    return pools.census(c, "k", 100)


@query("SELECT source AS term, count(*) AS count, min(doc_id) AS first_pos FROM documents GROUP BY source ORDER BY count DESC, first_pos LIMIT 12")
def most_common_terms(spark: SparkSession, d: str) -> DataFrame:
    return pools.most_common(read(spark, d, "documents").select(F.col("source").alias("term"), "doc_id"), "doc_id", 12)


@query("""WITH cur AS (SELECT n_name AS term, (n_nationkey + 1)::DOUBLE AS weight FROM nation), h AS (SELECT upper(c_mktsegment) AS term, count(*) AS c FROM customer GROUP BY 1 UNION ALL SELECT lower(n_name), 7 FROM nation),
    x AS (SELECT * FROM h WHERE lower(term) NOT IN (SELECT lower(term) FROM cur))
  SELECT term, round(weight, 6) AS weight FROM cur UNION ALL SELECT term, round(c * 0.35::DOUBLE * (SELECT sum(weight) FROM cur) / (SELECT sum(c) FROM x), 6) FROM x""")
def blended_pool(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    curated = n.select(F.col("n_name").alias("term"), (F.col("n_nationkey") + 1).cast("double").alias("weight"))
    harvested = pools.count(customers(spark, d).select(F.upper("c_mktsegment").alias("term"))).unionByName(n.select(F.lower("n_name").alias("term"), F.lit(7).cast("long").alias("count")))
    return pools.blended(curated, harvested).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- the catalog

_UUID = "(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12))"


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Trow''s city directory 1850-51' WHEN 1 THEN 'LAIN & HEALY Brooklyn, 1897' WHEN 2 THEN 'Old list of 1799' WHEN 3 THEN 'Undated' ELSE repeat('x', 300) END AS t FROM customer)
  SELECT k::VARCHAR AS id, CASE k % 5 WHEN 0 THEN 'Trow' WHEN 1 THEN 'Lain' ELSE '' END AS publisher, CASE k % 5 WHEN 0 THEN '1850/51' WHEN 1 THEN '1897' WHEN 2 THEN '1799' ELSE CASE WHEN k % 2 = 0 THEN '1820' ELSE '' END END AS year,
    'New York' AS city, 'Lib' AS holding_institution, t[1:200] AS title, CASE WHEN k % 5 < 2 THEN 'REVIEW: matches held-out eval signature — keep OUT of harvest set or confirm' ELSE '' END AS notes FROM c""")
def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    titles = {0: "\" Trow's city directory 1850-51 \"", 1: "'LAIN & HEALY Brooklyn, 1897'", 2: "'Old list of 1799'", 3: "'Undated'", 4: "repeat('x', 300)"}
    c = customers(spark, d, f"{by_class('k', 5, titles)} AS t", "CASE WHEN k % 5 > 2 AND k % 2 = 0 THEN '1820' END AS hint")
    return c.select(*catalog.make_row(F.lit("ia"), F.col("k").cast("string"), F.col("t"), F.col("hint"), F.lit("New York"), F.lit("Lib"))).select("id", "publisher", "year", "city", "holding_institution", "title", "notes")


_SUPPLIERS = "s AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation, md5(s_name) AS h, count(*) OVER () AS total FROM supplier)"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_nationkey AS nation", "md5(cast(s_name AS binary)) AS h")
    return s.join(F.broadcast(s.agg(F.count("*").alias("total"))), F.lit(True))  # one row


def _documents(rows: DataFrame, key: str, items: Column, more: dict[str, Column] | None = None, shape=lambda items, more: F.struct(items.alias("items"))) -> DataFrame:
    """A JSON document for each key, whose items are in order of k."""
    more = more or {}
    d = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", items.alias("item")))).alias("_items"), *[v.alias(n) for n, v in more.items()])
    listed = F.transform("_items", lambda x: x["item"])
    return d.select(key, F.to_json(shape(listed, {n: F.col(n) for n in more})).alias("j"))


_OUT = ["source", "id", "title", "year", "holding_institution"]


@query(f"""WITH {_SUPPLIERS}
  SELECT 'nypl' AS source, {_UUID} AS id, name || ' 1866 F' AS title, '1866' AS year, 'NYPL' AS holding_institution FROM s WHERE k % 5 <> 0
  UNION ALL SELECT 'ia', 'i' || k, name, CASE WHEN k % 3 = 0 THEN '1850' ELSE '1861' END, 'Internet Archive' FROM s WHERE k % 4 <> 0 AND k // 3 + 1 <= ceil((total - 5) / 3)
  UNION ALL SELECT 'loc', 'l' || k, name || ' 1870', '1870', 'Library of Congress' FROM s WHERE k % 6 IN (0, 1, 2)
  UNION ALL SELECT 'loc', 'n' || k, name, '1901', 'Library of Congress' FROM s
  UNION ALL SELECT 'iiif', CASE WHEN nation % 3 = 0 THEN 'm' ELSE 'x' END || k, name || ' two', '', '' FROM s WHERE nation % 3 <> 2 AND k % 5 <> 0
  UNION ALL SELECT DISTINCT 'iiif', 'http://here/' || nation, 'One manifest', '', '' FROM s WHERE nation % 3 = 2""")
def catalog_sources(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows from documents of each kind of source, with members that don't count among them."""
    s = _suppliers(spark, d)
    label = F.struct(F.array(F.concat("name", F.lit(" 1866")), F.lit("not this")).alias("en"), F.array(F.lit("F")).alias("fr"))
    items = F.struct(F.when(F.col("k") % 5 == 0, F.lit("https://x/none")).otherwise(F.concat(F.lit("https://x/"), F.expr(_UUID), F.lit("/m"))).alias("id"), label.alias("label"))
    out = metadata.collection_items(_documents(s, "nation", items), "j")

    found = F.struct(F.when(F.col("k") % 4 != 0, F.concat(F.lit("i"), "k")).alias("identifier"), F.col("name").alias("title"), F.when(F.col("k") % 3 == 0, 1850).alias("year"), F.lit("1861").alias("date"))
    paged = s.withColumn("page", F.floor(F.col("k") / 3) + 1)
    searched = _documents(paged, "page", found, {"n": F.first(F.col("total") - 5)}, lambda items, more: F.struct(F.struct(more["n"].alias("numFound"), items.alias("docs")).alias("response")))
    out = out.unionByName(metadata.search_pages(searched, "page", "j", per=3))

    kinds = F.when(F.col("k") % 6 == 0, F.array(F.lit("Text"))).when(F.col("k") % 6 == 1, F.array(F.lit("image"), F.lit("TEXT"))).when(F.col("k") % 6 == 3, F.array(F.lit("map")))
    url = F.when(F.col("k") % 6 == 1, F.concat(F.lit("http://www.loc.gov/resource/l"), "k", F.lit("?x"))).when(F.col("k") % 6 >= 4, F.lit("http://www.loc.gov/collections/none/")).otherwise(F.concat(F.lit("http://www.loc.gov/item/l"), "k", F.lit("/")))
    hit = F.struct(F.when(F.col("k") % 6 != 2, url).alias("id"), url.alias("url"), kinds.alias("type"), F.col("name").alias("title"), F.lit("1870").alias("date"))
    congress = _documents(s, "nation", hit, shape=lambda items, more: F.struct(items.alias("results")))
    out = out.unionByName(metadata.congress_results(congress, "j").withColumn("title", F.concat("title", F.lit(" 1870"))))
    item = s.select(F.concat(F.lit("https://www.loc.gov/item/n"), "k", F.lit("/?fo=json")).alias("url"), F.to_json(F.struct(F.struct(F.col("name").alias("title"), F.lit(1901).alias("date"), F.lit("other").alias("id")).alias("item"))).alias("j"))
    out = out.unionByName(metadata.congress_item(item, "j", "url"))

    member = lambda mark: F.struct(F.when(F.col("k") % 5 != 0, F.concat(F.lit(mark), "k")).alias("@id"), F.array("name", F.lit("two")).alias("label"))
    third = F.col("nation") % 3
    old = _documents(s.where(third == 0), "nation", member("m"), shape=lambda items, more: F.struct(F.lit("sc:Collection").alias("@type"), items.alias("manifests")))
    both = _documents(s.where(third == 1), "nation", member("x"), shape=lambda items, more: F.struct(F.lit("Collection").alias("type"), items.alias("items"), F.array(F.struct(F.lit("no").alias("id"))).alias("manifests")))
    alone = _documents(s.where(third == 2), "nation", member("n"), shape=lambda items, more: F.struct(F.lit("Manifest").alias("type"), F.lit("own id").alias("id"), F.lit("One manifest").alias("label"), items.alias("items")))
    for docs in (old, both, alone):
        out = out.unionByName(metadata.iiif(docs.withColumn("url", F.concat(F.lit("http://here/"), "nation")), "j", "url"))
    return out.select(*_OUT)


@query(f"""WITH {_SUPPLIERS}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY k) - 1 AS pos FROM s)
  SELECT nation, pos::INT AS pos, 'https://i/' || k AS service, 'img' || k AS image, CASE WHEN nation % 2 = 0 THEN 'p ' || k WHEN k % 2 = 0 THEN 'first' ELSE pos::VARCHAR END AS label,
    CASE WHEN k % 3 = 0 THEN 'img' || k ELSE 'https://i/' || k || '/full/1300,/0/default.jpg' END AS url FROM r""".replace("'https://i/' || k AS service", "CASE WHEN k % 3 = 0 THEN NULL ELSE 'https://i/' || k || '/' END AS service"))
def manifest_canvases(spark: SparkSession, d: str) -> DataFrame:
    """Canvases of manifests of both versions, and the image each is fetched from."""
    s = _suppliers(spark, d)
    service = F.when(F.col("k") % 3 != 0, F.concat(F.lit("https://i/"), "k", F.lit("/")))
    two = F.struct(F.concat(F.lit("p "), "k").alias("label"), F.array(F.struct(F.struct(F.concat(F.lit("img"), "k").alias("@id"), F.when(service.isNotNull(), F.struct(service.alias("@id"))).alias("service")).alias("resource"))).alias("images"))
    body = F.struct(F.concat(F.lit("img"), "k").alias("id"), F.when(service.isNotNull(), F.array(F.struct(service.alias("id")))).alias("service"))
    three = F.struct(F.when(F.col("k") % 2 == 0, F.struct(F.array(F.lit("first"), F.lit("second")).alias("none"))).alias("label"), F.array(F.struct(F.array(F.struct(body.alias("body"))).alias("items"))).alias("items"))
    even = _documents(s.where("nation % 2 = 0"), "nation", two, shape=lambda items, more: F.struct(F.array(F.struct(items.alias("canvases"))).alias("sequences")))
    odd = _documents(s.where("nation % 2 = 1"), "nation", three)
    c = metadata.canvases(even.unionByName(odd), "nation", "j")
    return c.select("nation", "pos", "service", "image", "label", metadata.image_url(F.col("service"), F.col("image")).alias("url"))


@query(f"""WITH {_SUPPLIERS}
  SELECT k, 'M' || k AS manifest_id, 'T ' || name AS title, 'T' AS first_title, CASE WHEN k % 2 = 0 THEN '1850' ELSE '' END AS year, 'id' || k AS identifier, 'folder m' || k || ' id' || k AS hay,
    CASE k % 5 WHEN 0 THEN 'https://api-collections.nypl.org/manifests/' || k WHEN 1 THEN 'https://iiif.archive.org/iiif/' || k || '/manifest.json' WHEN 2 THEN 'https://www.loc.gov/item/' || k || '/manifest.json' WHEN 3 THEN 'http' || k END AS url FROM s""")
def manifest_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What manifests say of themselves, the haystack of their ids, and where manifests are."""
    s = _suppliers(spark, d)
    entry = lambda label, value: F.struct(F.struct(F.array(F.lit(label)).alias("en")).alias("label"), value.alias("value"))
    values = F.array(entry("Date", F.array(F.when(F.col("k") % 2 == 0, "1850").otherwise(""))), entry("Identifier", F.array(F.concat(F.lit("id"), "k"))), entry("identifier", F.array(F.lit("later"))))
    j = s.select("k", F.to_json(F.struct(F.concat(F.lit("M"), "k").alias("@id"), F.struct(F.array(F.lit("T"), F.col("name")).alias("en")).alias("label"), values.alias("metadata"))).alias("j"))
    m = metadata.manifest_meta(j, "k", "j")
    sources = {0: "' NYPL'", 1: "'ia'", 2: "'loc'", 3: "'iiif'", 4: "'who'"}
    ident = F.expr("CASE k % 5 WHEN 3 THEN concat('http', k) ELSE cast(k AS string) END")
    return m.select("k", "manifest_id", "title", "first_title", "year", "identifier", metadata.haystack(F.lit("Folder"), F.col("manifest_id"), F.col("identifier")).alias("hay"), metadata.manifest_url(F.expr(by_class("k", 5, sources)), ident).alias("url"))


_HOLDERS = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS cls, c_custkey % 4 AS src FROM customer),
m AS (SELECT *, CASE cls WHEN 0 THEN 'Brooklyn Public Library' WHEN 1 THEN 'Own Library' WHEN 2 THEN 'Brooklyn Public Library' WHEN 3 THEN 'Columbia University Libraries' WHEN 4 THEN 'Allen County Public Library' END AS found,
  CASE cls WHEN 0 THEN 'contributor' WHEN 1 THEN 'contributor' WHEN 2 THEN 'uploader' WHEN 3 THEN 'collection' WHEN 4 THEN 'collection' END AS how FROM c),
b AS (SELECT k, found, how, CASE src WHEN 0 THEN coalesce(found, '') WHEN 1 THEN 'New York Public Library' WHEN 2 THEN 'Library of Congress' ELSE CASE WHEN k % 3 = 0 THEN 'Curated' ELSE 'Holder' END END AS institution FROM m)
"""


def _holders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items' metadata as JSON, strings or lists, resolved; and rows whose contributor is filled."""
    c = customers(spark, d, "k % 8 AS cls")
    is_ = lambda *cls: F.col("cls").isin(*cls)
    result = F.struct(
        F.when(is_(0), F.array(F.lit(" Brooklyn Public Library, Brooklyn Collection "), F.lit("second"))).when(is_(1), F.array(F.lit("Own Library"))).when(is_(5), F.array().cast("array<string>")).alias("contributor"),
        F.when(is_(2), "admin@bklynlibrary.org").alias("uploader"), F.when(is_(3), F.array(F.lit("a"), F.lit("DurstOldYorkLibrary"))).when(is_(4), F.array(F.lit("allen_county"))).alias("collection"),
    )
    docs = c.select(F.col("k").cast("string").alias("k"), F.to_json(F.struct(result.alias("result"))).alias("j"))
    resolved = catalog.resolve(metadata.contributors(docs, "k", "j"))
    known = {"source": F.element_at(F.array(*map(F.lit, ["ia", "nypl", "loc", "iiif"])), (F.col("k") % 4 + 1).cast("int")), "id": F.col("k").cast("string"), "holding_institution": F.lit("Holder"), "contributing_institution": F.when(F.col("k") % 3 == 0, "Curated").otherwise("")}
    rows = c.select(*[known.get(x, F.lit("")).alias(x) for x in CATALOG])
    return resolved, catalog.backfill(rows, resolved)


@query(_HOLDERS + "SELECT k::VARCHAR AS id, found, how, institution FROM b")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    resolved, filled = _holders(spark, d)
    return filled.join(resolved.withColumnRenamed("institution", "found"), "id").select("id", "found", "how", F.col("contributing_institution").alias("institution"))


@query(_HOLDERS + "SELECT institution AS contributing_institution, count(*) AS n FROM b GROUP BY institution")
def contributor_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.contributor_counts(_holders(spark, d)[1])


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Pub A' ELSE 'Pub B' END AS publisher_text, CASE WHEN c_custkey % 3 = 0 THEN '1850 T' ELSE '1860 T' END || CASE WHEN c_custkey % 2 = 0 THEN ' 2' ELSE '' END AS year_text,
    'T' || CASE WHEN c_custkey % 2 = 0 THEN ' 2' ELSE '' END AS title_text, CASE WHEN c_custkey % 3 = 0 THEN 'Queens' ELSE 'Bronx,Queens' END AS places FROM customer""")
def mods_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose parts are objects or lists, and values wrapped or bare."""
    c = customers(spark, d)
    wrapped = lambda x: F.struct(F.lit(x).alias("$"))
    number = F.when(F.col("k") % 2 == 0, wrapped("2"))
    titles = F.array(F.struct(F.lit(None).cast("string").alias("usage"), wrapped("other").alias("title"), F.lit(None).cast("struct<`$`:string>").alias("partNumber")), F.struct(F.lit("primary").alias("usage"), wrapped("T").alias("title"), number.alias("partNumber")))
    shape = lambda origin, subject: F.to_json(F.struct(F.struct(F.struct(F.struct(titles.alias("titleInfo"), origin.alias("originInfo"), subject.alias("subject")).alias("mods")).alias("response")).alias("nyplAPI")))
    one = shape(F.struct(wrapped("Pub A").alias("publisher"), F.array(wrapped("1850")).alias("dateIssued")), F.struct(wrapped("Queens").alias("geographic")))
    empty = F.lit(None).cast("string")
    many = shape(F.array(F.struct(empty.alias("publisher"), empty.alias("dateCreated")), F.struct(F.lit("Pub B").alias("publisher"), F.lit("1860").alias("dateCreated"))), F.array(F.struct(F.array(wrapped("Bronx")).alias("geographic")), F.struct(F.array(wrapped("Queens")).alias("geographic"))))
    docs = c.select(F.col("k").cast("string").alias("id"), F.when(F.col("k") % 3 == 0, one).otherwise(many).alias("j"))
    return metadata.mods(docs, "id", "j").select("id", "publisher_text", "year_text", "title_text", F.array_join("places", ",").alias("places"))


_VOLUMES = """
WITH v AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'v' || c_custkey % 400 END AS id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Trow' WHEN 2 THEN 'Lain|Co' ELSE 'Polk' END AS publisher,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE (1800 + c_custkey % 40)::VARCHAR END AS year, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2' END AS column_count,
  CASE c_custkey % 10 WHEN 0 THEN 'a Phonebook' WHEN 1 THEN 'by retrieval' WHEN 2 THEN 'biz list' WHEN 3 THEN 'bizarre' WHEN 4 THEN 'Keep Out' ELSE '' END AS notes, c_name AS title FROM customer),
scope AS (SELECT * FROM v WHERE id <> '' AND pos % 10 NOT IN (0, 1, 2, 4))
"""


def _volumes(spark: SparkSession, d: str) -> DataFrame:
    exprs = [
        "k AS pos", "CASE WHEN k % 9 = 0 THEN ' ' ELSE concat('v', k % 400) END AS id", f"{by_class('k', 4, {1: chr(39) + 'Trow' + chr(39), 2: chr(39) + 'Lain|Co' + chr(39), 3: chr(39) + 'Polk' + chr(39)})} AS publisher",
        "CASE WHEN k % 6 = 0 THEN '' ELSE cast(1800 + k % 40 AS string) END AS year", "CASE WHEN k % 3 = 0 THEN '' ELSE '2' END AS column_count",
        f"{by_class('k', 10, {0: chr(39) + 'a Phonebook' + chr(39), 1: chr(39) + 'by retrieval' + chr(39), 2: chr(39) + 'biz list' + chr(39), 3: chr(39) + 'bizarre' + chr(39), 4: chr(39) + 'Keep Out' + chr(39)})} AS notes", "c_name AS title",
    ]
    return read(spark, d, "customer").selectExpr("*", "c_custkey AS k").selectExpr(*exprs)


_STRATA = "CASE WHEN publisher = '' THEN 'unknown' ELSE publisher END"


@query(_VOLUMES + f""", t AS (SELECT *, 'publisher=' || {_STRATA} || ' · decade=' || CASE WHEN year = '' THEN '∅' ELSE (year::INT // 10 * 10) || 's' END AS stratum, CASE WHEN year = '' THEN 0 ELSE year::INT END AS y FROM scope),
  r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY y, pos) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM t)
SELECT id, pos, stratum, '| ' || replace(publisher, '|', '/') || ' | ' || year || ' | ' || id || ' | ' || title || ' |' AS line FROM r WHERE n <= 2 OR rn - 1 IN (0, n - 1)""")
def volume_pick(spark: SparkSession, d: str) -> DataFrame:
    """Two volumes of each publisher and decade, of those in scope, and their lines in the worklist."""
    v = sample.by_year(_volumes(spark, d).where(catalog.in_scope()))
    picked = sample.final_order(sample.select(v, sample.stratum(["publisher", "decade"]), ["year_number", "pos"], 2))
    return sinks.worklist(picked, "pos", "stratum")


@query(_VOLUMES + "SELECT id, pos FROM v WHERE publisher = 'Trow' AND column_count = '' AND id <> '' ORDER BY pos LIMIT 25")
def volume_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next 25 volumes whose columns are to be counted."""
    return catalog.picker(_volumes(spark, d), "pos", 25).select("id", "pos")


@query(_VOLUMES + ", x AS (SELECT id, max(pos) AS pos FROM v WHERE id <> '' GROUP BY id) SELECT id, pos, pos % 2 = 0 AS cached FROM x")
def volume_index(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each id, and whether its metadata is there already."""
    index = catalog.index_by_id(_volumes(spark, d).where(text.trim(F.col("id")) != ""), "pos")
    missing = catalog.to_fetch(index, index.where("pos % 2 = 0").select("id")).select("id", F.lit(False).alias("cached"))
    return index.join(missing, "id", "left").select("id", "pos", F.coalesce("cached", F.lit(True)).alias("cached"))


# ---------------------------------------------------------------- folders and pages

_FILES = "f AS (SELECT c_custkey AS k, 'r/v' || c_nationkey || '_x/' || lpad((c_custkey % 60)::VARCHAR, 4, '0') || '_' || c_custkey || CASE c_custkey % 10 WHEN 0 THEN '_viz' ELSE '' END || '.jpg' AS path, c_nationkey AS v FROM customer)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d, "concat('r/v', c_nationkey, '_x/', lpad(cast(k % 60 AS string), 4, '0'), '_', k, CASE WHEN k % 10 = 0 THEN '_viz' ELSE '' END, '.jpg') AS path").select("k", "path", F.col("c_nationkey").alias("v"))


@query(f"""WITH {_FILES}, p AS (SELECT * FROM f WHERE k % 10 <> 0), ids AS (SELECT DISTINCT 'v' || v || '_' AS id FROM f)
  SELECT id, count(*) AS n_files, max(path) FILTER (WHERE contains(path, '0021')) AS p1, max(path) FILTER (WHERE contains(path, '0022')) AS p2 FROM ids JOIN p ON contains(path, id) GROUP BY id""")
def listing_flags(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each volume among all files, its derived images left out."""
    files = _files(spark, d)
    listing = files.where(~F.col("path").rlike(readers.DERIVED)).select("path")
    return match.listing_flags(files.select(F.concat(F.lit("v"), "v", F.lit("_")).alias("id")).distinct(), listing)


@query(f"""WITH {_FILES}, p AS (SELECT *, (k % 60)::INT AS i FROM f WHERE k % 10 <> 0), j AS (SELECT *, i - lag(i) OVER (PARTITION BY v ORDER BY i) > 3 AS jump FROM p),
    a AS (SELECT *, bool_or(coalesce(jump, false)) OVER (PARTITION BY v ORDER BY i RANGE UNBOUNDED PRECEDING) AS after, bool_or(coalesce(jump, false)) OVER (PARTITION BY v) AS ever FROM j)
  SELECT path FROM a WHERE (after OR NOT ever) AND k % 4 <> 0""")
def pages_to_read(spark: SparkSession, d: str) -> DataFrame:
    """Pages after the front matter, all where none is found, without those that are done."""
    files = _files(spark, d).where(~F.col("path").rlike(readers.DERIVED))
    done = files.where("k % 4 = 0").select("path")
    return pages.to_read(files, "v", pages.canvas_index(F.col("path")), done, "path", gap=3).select("path")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), x AS (SELECT *, lower('Dir ' || v || ' M' || k) AS hay FROM c)
  SELECT k FROM x WHERE EXISTS (SELECT 1 FROM c y WHERE y.k % 100 = 7 AND contains(hay, 'm' || y.k))""")
def folders_selected(spark: SparkSession, d: str) -> DataFrame:
    """Folders whose haystack has an id of the worklist, whatever its case."""
    c = customers(spark, d, "concat('Dir ', c_nationkey, ' M', k) AS hay")
    return match.selected_folders(c.select("k", "hay"), "k", "hay", c.where("k % 100 = 7").select(F.concat(F.lit("M"), "k").alias("id"))).select("k")


@query("""WITH f AS (SELECT c_nationkey AS v, 'r/' || c_nationkey || '/' || CASE c_custkey % 5 WHEN 0 THEN 'entries_b' || c_custkey || '.csv' WHEN 1 THEN 'entries_a' || c_custkey || '_v2.csv' WHEN 2 THEN 'other.csv' WHEN 3 THEN 'entries_a_fixed.csv' ELSE 'entries_c.txt' END AS path, c_custkey % 5 AS cls FROM customer)
  SELECT 'r/' || v AS folder, arg_min(path, (cls <> 0, path)) AS path FROM f WHERE cls IN (0, 1, 3) GROUP BY v""")
def entries_tables(spark: SparkSession, d: str) -> DataFrame:
    names = {0: "concat('entries_b', k, '.csv')", 1: "concat('entries_a', k, '_v2.csv')", 2: "'other.csv'", 3: "'entries_a_fixed.csv'", 4: "'entries_c.txt'"}
    return readers.pick_entries(customers(spark, d, f"concat('r/', c_nationkey, '/', {by_class('k', 5, names)}) AS path").select("path"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS cls FROM customer)
  SELECT k, cls IN (0, 1) AS joined, cls = 2 AS lacks_image, cls <> 3 AND k % 5 = 0 AS year_differs, cls = 1 AS missing FROM c WHERE cls <> 3""")
def page_joins(spark: SparkSession, d: str) -> DataFrame:
    """Pages with and without their image, files that a listing lacks, and years that differ from the catalog's."""
    c = customers(spark, d, "k % 4 AS cls")
    ocr = c.where("cls <> 3").select("k", "cls", F.concat(F.lit("r/p"), "k", F.when(F.col("cls") == 0, "_surya.json").otherwise(".json")).alias("file"))
    images = c.where("cls <> 2").select(F.concat(F.lit("r/p"), "k", F.when(F.col("cls") == 1, ".jpeg").otherwise(".jpg")).alias("path"))
    both, alone = readers.pages_with_images(ocr, images)
    year = c.select("k", F.lit("1850").alias("y"), F.when(F.col("k") % 5 == 0, "1849/50").otherwise("1850/51").alias("cy"))
    differs = match.year_mismatch(year, F.col("y"), F.col("cy")).select("k", F.lit(True).alias("year_differs"))
    missing = match.missing_from(ocr.withColumn("path", F.concat(F.lit("r/p"), "k", F.lit(".jpg"))).where("cls < 2"), images, "path").select("k", F.lit(True).alias("missing"))
    out = both.select("k", F.lit(True).alias("joined"), F.lit(False).alias("lacks_image")).unionByName(alone.select("k", F.lit(False).alias("joined"), F.lit(True).alias("lacks_image")))
    return out.join(differs, "k", "left").join(missing, "k", "left").select("k", "joined", "lacks_image", F.coalesce("year_differs", F.lit(False)).alias("year_differs"), F.coalesce("missing", F.lit(False)).alias("missing"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS v, c_custkey % 6 AS cls FROM customer WHERE c_custkey % 6 NOT IN (4, 5))
  SELECT k, cls = 0 AS complete, (cls + 1)::INT AS n_columns, greatest(k % 50 - 6, 0)::INT AS left_, least(k % 50 + 20 + 6, 60)::INT AS right_, ((row_number() OVER (PARTITION BY v ORDER BY k) - 1) // 4)::BIGINT AS batch FROM c""")
def page_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whole JPEG files, columns of a page, crops, batches, and lines that are read surely enough."""
    c = customers(spark, d, "k % 6 AS cls")
    cls = F.col("cls")
    c = c.withColumn("confidence", F.when(cls == 4, 0.2).when(cls == 3, F.lit(None).cast("double")).otherwise(0.9)).withColumn("text", F.when(cls == 5, " \t").otherwise("x"))
    c = pages.readable(c, 0.5)
    content = F.unhex(F.concat(F.repeat(F.lit("00"), F.when(cls == 1, F.lit(100)).otherwise(F.lit(2500))), F.when(cls == 2, "FFD8").when(cls == 3, "FFD9AA").otherwise("FFD9")))
    override = F.when(cls == 0, F.lit(1)).when(cls == 2, F.lit(3))
    listed = F.when(cls == 1, " 2 ").when(cls == 3, "4").otherwise("x")
    box = F.array((F.col("k") % 50).cast("int"), F.lit(1), (F.col("k") % 50 + 20).cast("int"), F.lit(9))
    crop = pages.crop_box(box, F.lit(60), F.lit(100))
    numbered = pages.batches(c.select("k", "c_nationkey"), "c_nationkey", "k", 4)
    out = c.select("k", text.complete_jpeg(content).alias("complete"), pages.column_count(override, listed).alias("n_columns"), crop["left"].alias("left_"), crop["right"].alias("right_"))
    return out.join(numbered.select("k", "batch"), "k")


@query("SELECT vec_id, stddev_pop(x) < 0.13 AS blank FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as grey values."""
    return read(spark, d, "embeddings").select("vec_id", pages.is_blank(F.col("embedding").cast("array<double>"), 0.13).alias("blank"))


@query("""SELECT c_custkey AS k, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' & Sons' ELSE '' END || '|' || CASE WHEN c_custkey % 3 = 0 THEN 'True' ELSE 'False' END || '||' || '|' || c_mktsegment || '||' || CASE WHEN c_custkey % 2 = 0 THEN '5 Main' ELSE '6 Main' END || '|' AS pipe FROM customer""")
def span_records(spark: SparkSession, d: str) -> DataFrame:
    """Found spans as records: the surest of each label, of equally sure ones the first."""
    c = customers(spark, d)
    span = lambda label, value, points, pos: F.struct(F.lit(label).alias("label"), value.alias("text"), points.alias("score"), F.lit(pos).alias("pos"))
    name = F.concat("c_name", F.when(F.col("k") % 3 == 0, " & Sons").otherwise(""))
    spans = F.array(span("person name", F.lit("no"), F.lit(0.1), 0), span("person name", name, F.lit(0.9), 1), span("occupation", F.col("c_mktsegment"), F.lit(0.5), 2), span("address", F.lit("5 Main"), F.when(F.col("k") % 2 == 0, 0.8).otherwise(0.7), 3), span("address", F.lit("6 Main"), F.lit(0.8), 4))
    return pages.assembled(c.select("k", F.explode(spans).alias("s")).select("k", "s.*"), "k").select("k", codecs.to_pipe(F.struct(*FIELDS)).alias("pipe"))


# ---------------------------------------------------------------- reports, samples


@query("""WITH c AS (SELECT c_nationkey AS n, c_mktsegment AS s, arg_max(c_acctbal, c_custkey) AS v FROM customer GROUP BY ALL), p AS (SELECT 'set' || n AS ev, max(v) FILTER (WHERE s = 'BUILDING') AS a, max(v) FILTER (WHERE s = 'MACHINERY') AS b FROM c GROUP BY n)
  SELECT ev, '| ' || ev || ' | ' || coalesce(printf('%.3f', a / 1000), '—') || ' | ' || coalesce(printf('%.3f', b / 1000), '—') || ' |' AS line FROM p""")
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each evaluation set and label as a Markdown table."""
    labels = ["BUILDING", "MACHINERY"]
    log = customers(spark, d, "concat('data/set', c_nationkey, CASE WHEN k % 2 = 0 THEN '_eval.jsonl' ELSE '_gold.jsonl' END) AS gold", "c_acctbal / 1000 AS macro").withColumn("ev", report.eval_name(F.col("gold")))
    return report.markdown(report.last_wins(log, "ev", "c_mktsegment", ["macro"], F.col("k"), labels), "ev", labels, "macro")


@query("""WITH l AS (SELECT quality AS q, toxic AS t FROM labels), m AS (SELECT sum(CASE WHEN q = 1 AND t = 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN q = 1 THEN 1 ELSE 0 END) AS g, sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS p, count(*) AS n FROM l),
    f AS (SELECT n, c / p AS pr, c / g AS re, 2 * (c / p) * (c / g) / (c / p + c / g) AS f1 FROM m)
  SELECT 'quality' AS field, printf('%-18s P %.3f  R %.3f  F1 %.3f  ', 'quality', pr, re, f1) || rpad(repeat('#', round_even(f1 * 5, 0)::INT), 5, '.') AS line, n, round_even(f1, 3) AS macro_f1, 'g' AS gold FROM f""")
def score_report(spark: SparkSession, d: str) -> DataFrame:
    """Labels as gold, and not toxic as the prediction: a report's lines and the log's row."""
    both = read(spark, d, "labels")
    gold = both.select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "good").otherwise("").alias("quality"))
    pred = both.select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 0, "good").otherwise("").alias("quality"))
    pairs = score.zipped(gold, pred)
    row = score.run_row(pairs, "m", "g", "p", "2024", fields=["quality"]).select("n", F.col("per_field")["quality"]["f1"].alias("macro_f1"), "gold")
    return score.report(score.field_metrics(pairs, ["quality"])).join(row, F.lit(True))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id, turn) AS n FROM conversations WHERE turn = 0) WHERE n <= 40")
def shuffled_first(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 conversations of a seeded order."""
    return sample.first_shuffled(read(spark, d, "conversations").where("turn = 0"), "conv_id", 40).select("conv_id", "turn")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50")
def limited_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 rows of a stated order."""
    return readers.first_rows(read(spark, d, "events"), 50, "ts", "event_id").select("event_id")


# ---------------------------------------------------------------- the generator

DUCK = synth.Engine("list_transform(range(1, {n} + 1), lambda k: ('0x' || substr(md5({key}), 1, 8))::UBIGINT / 4294967296e0)", "{x}[{k}]", "regexp_matches({x}, '{pattern}')")
_GENERATED = synth.as_sql_rows("SELECT c_custkey AS row_id FROM customer", 7, 0.35, 0.75, DUCK)
_PIPE = " || '|' || ".join("CASE WHEN is_business THEN 'True' ELSE 'False' END" if f == "is_business" else f for f in FIELDS)


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """As many examples as there are customers, whose keys are 0 and following."""
    return synth.generate(spark, read(spark, d, "customer").count())


@query(f"SELECT row_id, profile, era, raw_line, publisher, alphabetical_range, directory_year, {_PIPE} AS pipe FROM ({_GENERATED})")
def synth_rows(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).select("row_id", "profile", "era", "raw_line", "context.*", codecs.to_pipe(F.col("record")).alias("pipe"))


@query(f"""WITH g AS ({_GENERATED}), t AS (SELECT profile, row_id, clean_line, unnest([{', '.join(f"{{'f': '{k}', 'hit': coalesce(({e}), false)}}" for k, e in synth.features(DUCK).items())}]) AS x FROM g)
  SELECT profile, x.f AS feature, count_if(x.hit)::BIGINT AS n, count(*) AS rows, arg_min(clean_line, row_id) FILTER (WHERE x.hit) AS example FROM t GROUP BY profile, x.f""")
def synth_statistics(spark: SparkSession, d: str) -> DataFrame:
    return synth.statistics(_generated(spark, d), "profile")


@query(f"SELECT profile, publisher, count(*) AS n FROM ({_GENERATED}) GROUP BY ALL")
def synth_publishers(spark: SparkSession, d: str) -> DataFrame:
    return synth.publisher_mix(_generated(spark, d))


@query(f"SELECT row_id, noisy FROM ({synth.as_sql('SELECT c_custkey AS row_id, c_mktsegment || chr(44) || chr(32) || c_name || chr(44) || c_nationkey AS line FROM customer', synth.noise_stages(11, 'line', 'noisy', 0.8, DUCK))})")
def noise_edits(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).select(F.col("k").alias("row_id"), F.concat("c_mktsegment", F.lit(", "), "c_name", F.lit(","), "c_nationkey").alias("noisy"))
    return synth.add_noise(c, "noisy", 11, 0.8)


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
    p AS (SELECT r.conv_id, r.turn AS r, e.turn AS e, len(list_intersect(r.w, e.w)) / (len(r.w) + len(e.w) - len(list_intersect(r.w, e.w))) AS likeness FROM w r JOIN w e ON r.conv_id = e.conv_id AND r.role = 'user' AND e.role = 'assistant' WHERE len(list_intersect(r.w, e.w)) > 0),
    ok AS (SELECT * FROM p WHERE likeness >= 0.05::DOUBLE),
    recs AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM w WHERE role = 'user'),
    m AS (SELECT conv_id, 0::BIGINT AS n, NULL::BIGINT AS record_pos, NULL::BIGINT AS entry_pos, NULL::DOUBLE AS likeness, []::BIGINT[] AS taken FROM recs WHERE n = 1
      UNION ALL SELECT m.conv_id, recs.n, recs.turn, best.e, best.likeness, CASE WHEN best.e IS NULL THEN m.taken ELSE list_append(m.taken, best.e) END
      FROM m JOIN recs ON recs.conv_id = m.conv_id AND recs.n = m.n + 1
      LEFT JOIN LATERAL (SELECT arg_min(e, (-ok.likeness, e)) AS e, max(ok.likeness) AS likeness FROM ok WHERE ok.conv_id = m.conv_id AND ok.r = recs.turn AND NOT list_contains(m.taken, ok.e)) best ON true)
  SELECT conv_id, record_pos, coalesce(entry_pos, -1) AS entry_pos, coalesce(round(likeness, 6), 0) AS likeness FROM m WHERE n > 0""")
def jaccard_match(spark: SparkSession, d: str) -> DataFrame:
    """User turns as records, assistant turns as entries of the same conversation; -1 where none is taken."""
    c = read(spark, d, "conversations")
    m = match.greedy_match(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "turn", "text", 0.05)
    return m.select("conv_id", "record_pos", F.coalesce("entry_pos", F.lit(-1).cast("long")).alias("entry_pos"), F.coalesce(F.round("likeness", 6), F.lit(0.0)).alias("likeness"))
