"""Every operator as a query over the driver's tables, and the same in SQL.

The operators' own inputs (label sets, catalogs, page files) aren't among those tables, so most queries are
analogues: the operator itself runs, on columns that stand in for its own.  Each runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, text
from ..operators import catalog, convert, estimate, match, pages, pools, report, sample, score, synth, validate
from ..schema import CATALOG, FIELDS
from ..sources import readers
from . import files, records


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def record(**given) -> F.Column:
    cells = {f: F.lit(False) if f == "is_business" else F.lit("") for f in FIELDS} | given
    return F.struct(*[cells[f].alias(f) for f in FIELDS])


# ---------------------------------------------------------------- scoring


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labels as gold; a rule on each document's text as prediction; unlabelled documents have no gold row."""
    gold = read(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    docs = read(spark, d, "documents")
    pred = docs.select(F.col("doc_id").alias("row_id"), F.when(F.length("text") < 100, "").when(F.contains("text", F.lit("|")), "0").otherwise("1.").alias("quality"), F.contains("text", F.lit("stupid")).alias("toxic"))
    return score.zipped(gold, pred)


_SCORED = ["quality", "toxic"]
_PAIRS_SQL = """
pairs AS (
  SELECT l.doc_id, CAST(quality AS VARCHAR) AS gq, CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END AS gt,
         CASE WHEN length(text) < 100 THEN '' WHEN contains(text, '|') THEN '0' ELSE '1.' END AS pq,
         CASE WHEN contains(text, 'stupid') THEN 'True' ELSE 'False' END AS pt
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
cells AS (
  SELECT doc_id, 'quality' AS field, gq AS g, pq AS p FROM pairs UNION ALL SELECT doc_id, 'toxic', gt, pt FROM pairs),
equal AS (SELECT *, lower(trim(rtrim(g, '.'))) = lower(trim(rtrim(p, '.'))) AS eq FROM cells),
tally AS (
  SELECT field, count(*) AS n, count_if(eq)::BIGINT AS em, count_if(g <> '')::BIGINT AS gold_ne, count_if(p <> '')::BIGINT AS pred_ne, count_if(eq AND g <> '')::BIGINT AS correct_ne
  FROM equal GROUP BY field),
rates AS (
  SELECT *, CASE WHEN pred_ne > 0 THEN correct_ne / pred_ne ELSE 0 END AS pr, CASE WHEN gold_ne > 0 THEN correct_ne / gold_ne ELSE 0 END AS re FROM tally),
full_rates AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM rates)
"""


def score_fields(spark: SparkSession, d: str) -> DataFrame:
    m = score.field_metrics(_pairs(spark, d), _SCORED)
    return m.select("field", "n", "gold_ne", "pred_ne", "correct_ne", F.col("em_pct"), "p", "r", "f1")


def score_overall(spark: SparkSession, d: str) -> DataFrame:
    o = score.overall(_pairs(spark, d), _SCORED)
    return o.select("n", "row_exact_pct", "macro_f1", "micro_f1", "fields_scored", F.array_join("spurious_fields", ",").alias("spurious"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def results_pivot_last_wins(spark: SparkSession, d: str) -> DataFrame:
    wide = report.last_wins(read(spark, d, "events"), "user_id", "event_type", ["value"], F.struct("ts", "event_id"), _TYPES)
    return wide.select("user_id", *[F.col(f"{t}.value").alias(t) for t in _TYPES])


def panel_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("w", F.length("source").cast("long"))
    return score.weighted_mean(docs, "n_chars", "w", ["lang"])


# ---------------------------------------------------------------- codecs, prompts, replies


def codec_pipe(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("r", record(name=F.col("c_name"), occupation_role=F.col("c_mktsegment"), address=F.col("c_nationkey").cast("string"), is_business=F.col("c_acctbal") < 0))
    c = c.withColumn("line", codecs.to_pipe(F.col("r"))).withColumn("b", codecs.parse_pipe(F.col("line")))
    return c.select("c_custkey", "line", F.col("b.name").alias("name"), F.col("b.is_business").alias("is_business"), F.col("b.home_address").alias("home_address"))


def codec_yaml(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("r", record(name=F.concat(F.col("p_name"), F.lit(' "x" \\')), occupation_role=F.col("p_type"), employer=F.col("p_brand")))
    p = p.withColumn("block", codecs.to_yaml(F.col("r"))).withColumn("b", codecs.parse_yaml(F.col("block"))).withColumn("u", codecs.parse_yaml(F.col("block"), unescape=True))
    return p.select("p_partkey", "block", F.col("b.name").alias("name"), F.col("u.name").alias("name_unescaped"), F.col("b.employer").alias("employer"), F.col("b.spouse_name").alias("spouse_name"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("role = 'user'")
    context = F.struct(F.when(F.col("turn") > 0, F.col("role")).alias("publisher"), F.col("conv_id").cast("string").alias("directory_year"))
    return c.select("conv_id", "turn", codecs.user_prompt(context, F.col("text")).alias("prompt"))


def response_parse(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    fenced = F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))
    return docs.select("doc_id", codecs.parse_response(fenced).alias("line"))


def first_record(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    block = F.concat(F.lit("name: \""), F.col("p_name"), F.lit("\"\nemployer: \""), F.col("p_brand"), F.lit("\"\nname: \"cut\"\naddress: \"lost\""))
    return p.select("p_partkey", codecs.first_record(block).alias("block"), codecs.runs_away(block).alias("runs_away"))


# ---------------------------------------------------------------- sources


def url_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.detect_source(F.col("url")).alias("s")).select("page_id", "s.kind", "s.ident")


def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    return p.select("page_id", F.array_join(convert.tagged(F.col("html"), "title"), "|").alias("titles"), F.array_join(convert.tagged(F.col("html"), "p"), "|").alias("paragraphs"))


def corrupt_json_tally(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("line", F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 2)")).otherwise(F.col("props")))
    return readers.corrupt_tally(readers.tolerant_json(e, "line", "k STRING"))


# ---------------------------------------------------------------- catalog


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.lower(text.squeeze(F.col("text"))).cast("binary"))
    return read(spark, d, "documents").select("doc_id", F.upper("lang").alias("source"), key.alias("id"))


def anti_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents new to a catalog of benchmark texts (in English) and of the texts of toxic documents."""
    bench = read(spark, d, "benchmark").select(F.lit("en").alias("source"), F.md5(F.lower(text.squeeze(F.col("text"))).cast("binary")).alias("id"))
    toxic = _fresh(spark, d).join(read(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").drop("doc_id")
    return catalog.new_rows(_fresh(spark, d), "doc_id", bench, toxic)


def merge_pending(spark: SparkSession, d: str) -> DataFrame:
    master = read(spark, d, "region").select(F.lit("geo").alias("source"), F.col("r_name").alias("id"), F.lit("region").alias("title"))
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lit("GEO ").alias("source"), F.col("n_name").alias("id"), F.lit("nation").alias("title"))
    regions = read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("pos"), F.lit("Geo").alias("source"), F.col("r_name").alias("id"), F.lit("again").alias("title"))
    merged, left = catalog.merge_pending(master, nations.unionByName(regions), "pos")
    return merged.groupBy("title").agg(F.count("*").alias("n")).withColumn("still_pending", F.lit(0)).unionByName(left.groupBy("title").agg(F.count("*").alias("n")).withColumn("still_pending", F.lit(1)))


def enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    blank = [F.lit("").alias(x) for x in CATALOG if x not in ("source", "id", "publisher")]
    rows = c.select(F.lit("c").alias("source"), F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "Curated").otherwise("").alias("publisher"), *blank)
    found = c.select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "Trow City Co").otherwise(F.col("c_mktsegment")).alias("publisher_text"),
        F.concat(F.lit("printed "), (1840 + F.col("n_nationkey")).cast("string"), F.lit("-"), (41 + F.col("n_nationkey")).cast("string")).alias("year_text"),
        F.when(F.col("c_acctbal") > 5000, "Brooklyn and Queens").when(F.col("c_acctbal") > 0, "Brooklyn").otherwise("County").alias("title_text"), F.lit(None).cast("string").alias("error"),
    )
    return catalog.enrich(rows, found, ["id"]).select("id", "publisher", "year", "title", "borough", "notes")


def year_parse(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("for "), F.year("o_orderdate").cast("string"), F.lit(" - "), (F.year("o_orderdate") + 1).cast("string"))).otherwise(F.concat(F.lit("of "), F.year("o_orderdate").cast("string")))
    parsed = text.parse_year(F.when(F.col("o_orderstatus") == "P", F.lit("undated")).otherwise(F.regexp_replace(title, r"\b(\d)", "$1")))
    return o.select("o_orderkey", parsed.alias("year"), text.decade(parsed).alias("decade"))


def recase(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.col("n_name"), F.concat(F.lit("MC"), F.col("n_name")), F.concat(F.col("n_name"), F.lit("-"), F.col("n_name")), F.lit("OBRIEN"))).alias("raw"))
    return c.select("n_nationkey", "raw", text.recase(F.col("raw")).alias("name"))


# ---------------------------------------------------------------- joins


def containment_longest(spark: SparkSession, d: str) -> DataFrame:
    return match.longest_contained(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "benchmark").withColumnRenamed("text", "passage"), "passage", "item_id")


def containment_any(spark: SparkSession, d: str) -> DataFrame:
    return match.having_any(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", read(spark, d, "benchmark").withColumnRenamed("text", "passage"), "passage").select("doc_id")


def interval_rebuild(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").withColumn("owner", F.when(F.col("role") == "user", F.col("turn")))
    return convert.owned_text(c, "conv_id", "turn", "text", "owner")


# ---------------------------------------------------------------- windows


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    head = convert.carried_forward(e, "user_id", "at", F.col("value"), F.col("event_type") == "signup")
    return e.select("event_id", "user_id", head.alias("head"))


def gap_split(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("int").alias("hour"))
    return pages.after_gap(e, "user_id", F.col("hour"), 48)


def _strata(spark: SparkSession, d: str) -> tuple:
    return read(spark, d, "documents"), F.concat_ws("/", "lang", "source"), ["n_chars", "doc_id"]


def stratified_spread(spark: SparkSession, d: str) -> DataFrame:
    return sample.select(*_strata(spark, d), 3).select("doc_id", "stratum")


def roundrobin_cap(spark: SparkSession, d: str) -> DataFrame:
    return sample.select(*_strata(spark, d), 3, cap=100).select("doc_id", "stratum")


def depth_class(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_brand") == "Brand#11", "Lain & Co").otherwise(F.col("p_brand")).alias("publisher"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise((F.col("p_size") % 3).cast("string")).alias("column_count"))
    return sample.depth(p, p).select("p_partkey", "depth", "target", "why")


def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(read(spark, d, "documents"), F.col("lang"), F.col("text"), "doc_id").select("doc_id", "nth")


def column_order(spark: SparkSession, d: str) -> DataFrame:
    """Embedding coordinates as boxes, labels as pages."""
    e = read(spark, d, "embeddings")
    px = lambda k: F.floor((F.get("embedding", F.lit(k)).cast("double") + 1) * 500).cast("int")
    boxes = e.select("vec_id", "label", F.array(px(0), px(1), px(0) + 40, px(1) + 10).alias("box"))
    return pages.reading_order(boxes, "label", "box", F.lit(1000), F.lit(3), "vec_id").select("vec_id", "label", F.col("column").cast("int").alias("column"), "reading_pos")


def page_gate(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    reads = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("page1_printed_page"), F.col("l_linenumber").alias("page2_printed_page"), F.pmod("l_partkey", F.lit(100)).cast("int").alias("l1"), F.pmod("l_suppkey", F.lit(50)).cast("int").alias("l2"), F.when(F.col("l_returnflag") == "N", 30).alias("total"))
    return pages.gate(reads).select("l_orderkey", "l_linenumber", "l1", "l2", "page_offset", "offset_status")


# ---------------------------------------------------------------- pools


def _pool(docs: DataFrame) -> DataFrame:
    return pools.count(docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")))


def _two_pools(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    return _pool(docs.where("lang in ('en', 'de')")), _pool(docs.where("lang not in ('en', 'de')"))


def term_pool_merge(spark: SparkSession, d: str) -> DataFrame:
    return pools.merge(*_two_pools(spark, d))


def tempered_pool(spark: SparkSession, d: str) -> DataFrame:
    t = pools.tempered(*_two_pools(spark, d))
    return t.select("term", F.round("weight", 6).alias("weight"))


def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    pool = read(spark, d, "nation").select(F.col("n_name").alias("term"), (F.col("n_nationkey") + 1).cast("double").alias("weight"))
    c = read(spark, d, "customer").select("c_custkey")
    return pools.draw(c, synth.Draws(5, F.col("c_custkey")).u("nation"), pool, "nation")


def occupation_pool(spark: SparkSession, d: str) -> DataFrame:
    """Documents' sentences as predicted occupations: of those over several lines the first line, as a block has it; most are too long to be kept."""
    docs = read(spark, d, "documents").select(F.explode(F.split("text", r"\. ")).alias("s"))
    block = F.concat(F.lit("name: x\noccupation_role: \""), "s", F.lit("\""))
    return pools.occupations(docs.select(block.alias("block")), "block")


# ---------------------------------------------------------------- rules


def validate_findings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records: the name is the line, type the occupation, brand the address, size the home."""
    p = read(spark, d, "part")
    rec = {f: F.lit(False) if f == "is_business" else F.lit("") for f in FIELDS} | {
        "name": F.col("p_name"), "occupation_role": F.col("p_type"), "address": F.when(F.col("p_size") < 5, "").otherwise(F.col("p_brand")),
        "home_address": F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("h "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("r"), F.col("p_size").cast("string"))).otherwise(""),
    }
    return validate.findings(p.withColumn("file", F.lit("part")), "file", "p_partkey", validate.record_rules(F.col("p_name"), rec)).select("p_partkey", "severity", "rule", "detail")


def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return validate.fill_rates(docs.select("text", "lang", "source", F.col("quality").cast("string").alias("quality"), (F.col("toxic") == 1).alias("toxic")), ["text", "lang", "source", "quality", "toxic"])


def line_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", text.is_ocr_junk(F.col("text")).alias("junk"), text.clean_occupation(F.col("text")).alias("occupation"))


# ---------------------------------------------------------------- generator and estimates


def synth_draws(spark: SparkSession, d: str) -> DataFrame:
    r = synth.Draws(7, F.col("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", r.u("a").alias("u"), r.integer("b", 1, 900).alias("house"), text.ordinal(r.integer("c", 1, 155)).alias("street"), r.weighted("d", synth.PREFIXES).alias("prefix"))


def run_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Each size and GPU with as many rows as each region's key times 100,000."""
    rows = estimate.grid(spark).join(F.broadcast(read(spark, d, "region").select("r_regionkey")), F.lit(True))  # 15 rows by 5
    e = estimate.estimate(rows, (F.col("r_regionkey") + 1) * 100_000, F.lit(3.0))
    return e.select("size", "gpu", "r_regionkey", F.col("batch").cast("int").alias("batch"), *[F.round(c, 4).alias(c) for c in ("vram", "sps", "hours", "cost")], F.col("jobs").cast("long").alias("jobs"))


QUERIES = {f.__name__: f for f in (
    score_fields, score_overall, results_pivot_last_wins, panel_weighted_mean, codec_pipe, codec_yaml, prompt_build, response_parse, first_record, url_dispatch, tag_extract,
    corrupt_json_tally, anti_dedup, merge_pending, enrichment, year_parse, recase, containment_longest, containment_any, interval_rebuild, carry_forward, gap_split,
    stratified_spread, roundrobin_cap, depth_class, duplicate_flags, column_order, page_gate, term_pool_merge, tempered_pool, weighted_draw, occupation_pool, validate_findings,
    fill_rates, line_quality_gate, synth_draws, run_estimate,
)} | records.QUERIES | files.QUERIES

_SQUEEZED = r"trim(regexp_replace(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{1680}]+', ' ', 'g'))"
_U = "('0x' || substr(md5('{seed}:' || {row}::VARCHAR || ':{name}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


def _u(seed: int, row: str, name: str) -> str:
    return "(" + _U.format(seed=seed, row=row, name=name) + ")"


_POOL = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents WHERE lang {} ('en', 'de')"
_PICKED = """
ranked AS (SELECT doc_id, lang || '/' || source AS stratum, row_number() OVER w AS rn, count(*) OVER (PARTITION BY lang, source) AS n
  FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars, doc_id)),
picked AS (SELECT * FROM ranked WHERE n <= 3 OR rn - 1 IN (0, round_even((n - 1) / 2, 0), n - 1))
"""
_SIZES_SQL = ", ".join(f"('{n}', {h}::BIGINT, {k}::BIGINT, {p}::DOUBLE)" for n, h, k, p in estimate.SIZES)
_GPUS_SQL = ", ".join(f"('{n}', {s}::DOUBLE, {m}::DOUBLE, {'NULL' if r is None else r}::DOUBLE)" for n, s, m, r in estimate.GPUS)
_PREFIX_SQL = "CASE " + " ".join(f"WHEN {_u(7, 'c_custkey', 'd')} < {sum(w for _, w in synth.PREFIXES[: k + 1])}.0::DOUBLE / {sum(w for _, w in synth.PREFIXES)} THEN '{v}'" for k, (v, _) in enumerate(synth.PREFIXES[:-1])) + f" ELSE '{synth.PREFIXES[-1][0]}' END"

ORACLE_SQL = {
    "score_fields": f"""WITH {_PAIRS_SQL} SELECT field, n, gold_ne, pred_ne, correct_ne, round_even(100.0::DOUBLE * em / n, 1) AS em_pct,
        round_even(pr, 3) AS p, round_even(re, 3) AS r, round_even(f, 3) AS f1 FROM full_rates""",
    "score_overall": f"""WITH {_PAIRS_SQL}, pooled AS (SELECT sum(correct_ne) / sum(pred_ne) AS p, sum(correct_ne) / sum(gold_ne) AS r FROM tally),
        exact AS (SELECT count(*) AS n, count_if(ok)::BIGINT AS k FROM (SELECT doc_id, bool_and(eq) AS ok FROM equal GROUP BY doc_id))
      SELECT exact.n, round_even(100.0::DOUBLE * k / exact.n, 1) AS row_exact_pct,
        (SELECT round_even(avg(f) FILTER (WHERE gold_ne > 0), 3) FROM full_rates) AS macro_f1, round_even(2 * p * r / (p + r), 3) AS micro_f1,
        (SELECT count_if(gold_ne > 0)::BIGINT FROM tally) AS fields_scored, '' AS spurious FROM exact, pooled""",
    "results_pivot_last_wins": "SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id",
    "panel_weighted_mean": "SELECT lang, sum(n_chars * length(source)) / sum(length(source)) AS n_chars_weighted, sum(length(source))::BIGINT AS lines FROM documents GROUP BY lang",
    "codec_pipe": """SELECT c_custkey, c_name || '|' || CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END || '|||' || c_mktsegment || '||' || c_nationkey || '|' AS line,
        c_name AS name, CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS is_business, '' AS home_address FROM customer""",
    "codec_yaml": r"""SELECT p_partkey, 'name: "' || p_name || ' \"x\" \\"' || chr(10) || 'is_business: False' || chr(10) || 'spouse_name: ""' || chr(10) || 'race_designation: ""' || chr(10)
        || 'occupation_role: "' || p_type || '"' || chr(10) || 'employer: "' || p_brand || '"' || chr(10) || 'address: ""' || chr(10) || 'home_address: ""' AS block,
        p_name || ' \"x\" \\' AS name, p_name || ' "x" \' AS name_unescaped, p_brand AS employer, '' AS spouse_name FROM part""",
    "prompt_build": "SELECT conv_id, turn, '[publisher=' || CASE WHEN turn > 0 THEN role ELSE '?' END || '; year=' || conv_id || '] ' || text AS prompt FROM conversations WHERE role = 'user'",
    "response_parse": r"""WITH plain AS (SELECT doc_id, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10)) AS ls FROM documents)
      SELECT doc_id, trim(coalesce(list_filter(ls, lambda x: contains(x, '|'))[1], ls[1], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM plain""",
    "first_record": "SELECT p_partkey, 'name: \"' || p_name || '\"' || chr(10) || 'employer: \"' || p_brand || '\"' AS block, true AS runs_away FROM part",
    "url_dispatch": r"""SELECT page_id, CASE WHEN contains(u, 'loc.gov') THEN 'loc' WHEN regexp_matches(u, 'digitalcollections\.nypl\.org|api-collections\.nypl\.org') THEN 'nypl'
        WHEN contains(u, 'archive.org') THEN 'ia' WHEN starts_with(u, 'http') THEN 'iiif' ELSE 'ia' END AS kind, u AS ident FROM (SELECT page_id, trim(url) AS u FROM pages)""",
    "tag_extract": r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS a, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages)
      SELECT page_id, array_to_string(list_filter([trim(regexp_replace(regexp_replace(i, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) for i in a], lambda i: i <> ''), '|') AS titles,
        array_to_string(list_filter([trim(regexp_replace(regexp_replace(i, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) for i in b], lambda i: i <> ''), '|') AS paragraphs FROM x""",
    "corrupt_json_tally": "SELECT count(*) AS read, count_if(event_type = 'error')::BIGINT AS bad FROM events",
    "anti_dedup": f"""WITH k AS (SELECT doc_id, upper(lang) AS source, md5(lower({_SQUEEZED})) AS id FROM documents),
        known AS (SELECT 'en' AS s, md5(lower({_SQUEEZED})) AS id FROM benchmark UNION SELECT lower(source), id FROM k WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
      SELECT min(doc_id) AS doc_id, source, id FROM k WHERE NOT EXISTS (SELECT 1 FROM known WHERE s = lower(k.source) AND known.id = k.id) GROUP BY source, id""",
    "merge_pending": "SELECT 'region' AS title, count(*) AS n, 0 AS still_pending FROM region UNION ALL SELECT 'nation', count(*), 0 FROM nation",
    "enrichment": """WITH f AS (
        SELECT c_custkey::VARCHAR AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Curated' WHEN c_mktsegment = 'MACHINERY' THEN 'Trow' ELSE c_mktsegment END AS publisher,
          (1840 + n_nationkey) || '/' || (41 + n_nationkey) AS year, CASE WHEN c_acctbal > 5000 THEN 'Brooklyn and Queens' WHEN c_acctbal > 0 THEN 'Brooklyn' ELSE 'County' END AS title
        FROM customer JOIN nation ON c_nationkey = n_nationkey),
        g AS (SELECT *, CASE WHEN title = 'Brooklyn and Queens' THEN 'covers Brooklyn, Queens' ELSE '' END AS span,
          CASE WHEN publisher = 'Trow' AND contains(year, '1850') THEN 'REVIEW: matches held-out eval signature — keep OUT of harvest set or confirm' ELSE '' END AS flag FROM f)
      SELECT id, publisher, year, title, CASE WHEN title = 'Brooklyn' THEN 'Brooklyn' ELSE '' END AS borough,
        CASE WHEN flag = '' THEN span WHEN span = '' THEN flag ELSE flag || ' | ' || span END AS notes FROM g""",
    "year_parse": """WITH y AS (SELECT o_orderkey, o_orderstatus AS s, year(o_orderdate) AS y FROM orders)
      SELECT o_orderkey, CASE s WHEN 'P' THEN '' WHEN 'F' THEN y || '/' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') ELSE y::VARCHAR END AS year,
        CASE s WHEN 'P' THEN '∅' ELSE (y // 10 * 10) || 's' END AS decade FROM y""",
    "recase": """WITH c AS (SELECT n_nationkey, n_name, upper(n_name[1]) || lower(n_name[2:]) AS t FROM nation)
      SELECT n_nationkey, n_name AS raw, CASE WHEN starts_with(upper(n_name), 'MC') THEN NULL ELSE t END AS name FROM c
      UNION ALL SELECT n_nationkey, 'MC' || n_name, 'Mc' || t FROM c UNION ALL SELECT n_nationkey, n_name || '-' || n_name, t || '-' || t FROM c
      UNION ALL SELECT n_nationkey, 'OBRIEN', 'O''Brien' FROM c""",
    "containment_longest": """SELECT doc_id, arg_max(b.text, (length(b.text), -item_id)) AS passage FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id""",
    "containment_any": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
    "interval_rebuild": r"""WITH o AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS owner,
          trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations)
      SELECT conv_id, owner, coalesce(string_agg(t, ' ' ORDER BY turn) FILTER (WHERE t <> ''), '') AS text FROM o WHERE owner IS NOT NULL GROUP BY conv_id, owner""",
    "carry_forward": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS head FROM events",
    "gap_split": """WITH h AS (SELECT event_id, user_id, (epoch_us(ts) // 3600000000)::INT AS hour FROM events),
        j AS (SELECT *, coalesce(hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour, event_id) > 48, false) AS jump FROM h)
      SELECT event_id, user_id, hour FROM j QUALIFY bool_or(jump) OVER (PARTITION BY user_id ORDER BY hour RANGE UNBOUNDED PRECEDING)""",
    "stratified_spread": f"WITH {_PICKED} SELECT doc_id, stratum FROM picked",
    "roundrobin_cap": f"""WITH {_PICKED}, s AS (SELECT stratum, row_number() OVER (ORDER BY max(n) DESC, stratum) AS rank FROM picked GROUP BY stratum),
        t AS (SELECT doc_id, stratum, rank, row_number() OVER (PARTITION BY stratum ORDER BY rn) AS round FROM picked JOIN s USING (stratum))
      SELECT doc_id, stratum FROM (SELECT * FROM t ORDER BY round, rank LIMIT 100)""",
    "depth_class": """WITH p AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'Lain & Co' ELSE p_brand END AS b, CASE WHEN p_size % 5 <> 0 THEN p_size % 3 END AS c FROM part),
        k AS (SELECT b, list_sort(list(DISTINCT c) FILTER (WHERE c IS NOT NULL)) AS cs FROM p GROUP BY b)
      SELECT p_partkey, CASE WHEN b = 'Lain & Co' OR len(cs) > 1 THEN 'deep' ELSE 'std' END AS depth, CASE WHEN b = 'Lain & Co' OR len(cs) > 1 THEN 100 ELSE 40 END AS target,
        CASE WHEN b = 'Lain & Co' THEN 'synth→real gap (Lain)' WHEN len(cs) > 1 THEN 'col-transition (' || array_to_string(cs, '→') || ')' ELSE '' END AS why FROM p JOIN k USING (b)""",
    "duplicate_flags": f"SELECT doc_id, nth::INT AS nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, {_SQUEEZED} ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1",
    "column_order": """WITH b AS (SELECT vec_id, label, floor((embedding[1]::DOUBLE + 1) * 500)::INT AS x, floor((embedding[2]::DOUBLE + 1) * 500)::INT AS y FROM embeddings),
        c AS (SELECT *, greatest(0, least(2, floor(((x + x + 40) / 2) / (1000 / 3))))::INT AS col FROM b)
      SELECT vec_id, label, col AS "column", (row_number() OVER (PARTITION BY label ORDER BY col, y, vec_id) - 1)::INT AS reading_pos FROM c""",
    "page_gate": """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS p1, l_linenumber AS p2, (l_partkey % 100)::INT AS l1, (l_suppkey % 50)::INT AS l2, CASE WHEN l_returnflag = 'N' THEN 30 END AS t FROM lineitem),
        o AS (SELECT *, coalesce(CASE WHEN p1 > 0 AND (t IS NULL OR p1 <= t) AND l1 - p1 BETWEEN -25 AND 60 THEN l1 - p1 END, CASE WHEN p2 > 0 AND (t IS NULL OR p2 <= t) AND l2 - p2 BETWEEN -25 AND 60 THEN l2 - p2 END) AS f FROM r)
      SELECT l_orderkey, l_linenumber, l1, l2, f AS page_offset, CASE WHEN f IS NULL THEN 'ESCALATE' ELSE 'ok' END AS offset_status FROM o""",
    "term_pool_merge": "SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term",
    "tempered_pool": f"""WITH a AS (SELECT term, count(*) AS n FROM ({_POOL.format('IN')}) GROUP BY term), b AS (SELECT term, count(*) AS n FROM ({_POOL.format('NOT IN')}) GROUP BY term)
      SELECT term, round(coalesce(pow(a.n, 0.3::DOUBLE), 0) + coalesce(8 * pow(b.n, 0.5::DOUBLE), 0), 6) AS weight FROM a FULL JOIN b USING (term)""",
    "weighted_draw": f"""WITH p AS (SELECT n_name, sum(n_nationkey + 1) OVER (ORDER BY n_name) AS hi, n_nationkey + 1 AS w, sum(n_nationkey + 1) OVER () AS t FROM nation),
        u AS (SELECT c_custkey, {_u(5, 'c_custkey', 'nation')} AS u FROM customer)
      SELECT c_custkey, n_name AS nation FROM u JOIN p ON u >= (hi - w)::DOUBLE / t AND u < hi::DOUBLE / t""",
    "occupation_pool": r"""WITH s AS (SELECT unnest(string_split(text, '. ')) AS s FROM documents),
        c AS (SELECT regexp_replace(trim(trim(trim(regexp_extract('"' || s || '"', '^(?m:(.*)$)', 1), '"'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ',;'), '\s+', ' ', 'g') AS o FROM s)
      SELECT o AS term, count(*) AS count FROM c WHERE o <> '' AND length(o) <= 42 AND NOT contains(o, ':') AND NOT regexp_matches(o, '\d')
        AND NOT (regexp_matches(o, '(?i)(^|[^\p{L}\p{N}_])(st|street|av|ave|avenue|lane|pl|place|road|rd|sq|square|row|slip|alley|wharf|dock|market|cor|corner)($|[^\p{L}\p{N}_])') AND NOT contains(lower(o), 'house') AND NOT contains(lower(o), 'store'))
        AND lower(o) NOT IN ('do', 'do.', 'none', 'n/a', 'the', 'and') AND regexp_matches(o, '[a-z]') GROUP BY o""",
    "validate_findings": r"""WITH r AS (SELECT *, CASE WHEN p_size < 5 THEN '' ELSE p_brand END AS a, CASE p_size % 3 WHEN 0 THEN 'h ' || p_size WHEN 1 THEN 'r' || p_size ELSE '' END AS h,
          regexp_extract_all(lower(p_name), '[a-z0-9]+') AS raw FROM part),
        x AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains(raw, t)))) AS dt,
          list_sort(list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains(raw, t)))) AS da FROM r)
      SELECT p_partkey, 'warning' AS severity, 'token_drift' AS rule, 'occupation_role: ' || array_to_string(dt, ' ') AS detail FROM x WHERE len(dt) > 0
      UNION ALL SELECT p_partkey, 'warning', 'token_drift', 'address: ' || array_to_string(da, ' ') FROM x WHERE len(da) > 0
      UNION ALL SELECT p_partkey, 'warning', 'home_without_address', h FROM x WHERE h <> '' AND a = ''
      UNION ALL SELECT p_partkey, 'error', 'home_mark', h FROM x WHERE starts_with(h, 'h ')
      UNION ALL SELECT p_partkey, 'warning', 'home_mark_unsure', h FROM x WHERE starts_with(h, 'r')""",
    "fill_rates": """WITH d AS (SELECT text, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
      SELECT 'text' AS field, count_if(trim(text) <> '')::BIGINT AS filled, count(*) AS n FROM d UNION ALL SELECT 'lang', count_if(lang <> '')::BIGINT, count(*) FROM d
      UNION ALL SELECT 'source', count_if(source <> '')::BIGINT, count(*) FROM d UNION ALL SELECT 'quality', count(quality), count(*) FROM d UNION ALL SELECT 'toxic', count_if(toxic = 1)::BIGINT, count(*) FROM d""",
    "line_quality_gate": r"""WITH c AS (SELECT conv_id, turn, text, regexp_replace(trim(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ',;'), '\s+', ' ', 'g') AS o FROM conversations)
      SELECT conv_id, turn, length(text) < 8 OR regexp_matches(text, '^\W*\d{1,4}\W*$') OR NOT regexp_matches(text, '[a-z]') OR length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) < 0.85 AS junk,
        CASE WHEN o = '' OR length(o) > 42 OR contains(o, ':') OR regexp_matches(o, '\d') OR lower(o) IN ('do', 'do.', 'none', 'n/a', 'the', 'and') OR NOT regexp_matches(o, '[a-z]')
          OR (regexp_matches(o, '(?i)(^|[^\p{L}\p{N}_])(st|street|av|ave|avenue|lane|pl|place|road|rd|sq|square|row|slip|alley|wharf|dock|market|cor|corner)($|[^\p{L}\p{N}_])') AND NOT contains(lower(o), 'house') AND NOT contains(lower(o), 'store')) THEN '' ELSE o END AS occupation FROM c""",
    "synth_draws": f"""WITH c AS (SELECT c_custkey, {_u(7, 'c_custkey', 'a')} AS u, (floor({_u(7, 'c_custkey', 'b')} * 900) + 1)::INT AS house, (floor({_u(7, 'c_custkey', 'c')} * 155) + 1)::INT AS n, {_PREFIX_SQL} AS prefix FROM customer)
      SELECT c_custkey, u, house, n || CASE WHEN n % 100 IN (11, 12, 13) THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 IN (2, 3) THEN 'd' ELSE 'th' END AS street, prefix FROM c""",
    "run_estimate": f"""WITH s(size, h, k, p) AS (VALUES {_SIZES_SQL}), g(gpu, f, m, r) AS (VALUES {_GPUS_SQL}),
        b AS (SELECT s.*, g.*, r_regionkey, batch, p * 2 * 1.15::DOUBLE + batch * 512 * 248320 * 7 / 1e9 + h * k * batch * 512 * 16 / 1e9 AS vram FROM s, g, region, (SELECT unnest([1, 2, 4, 8, 16, 32, 64])::BIGINT AS batch)),
        c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY size, gpu, r_regionkey ORDER BY CASE WHEN vram <= m * 0.9::DOUBLE THEN batch ELSE 0 END DESC, batch) = 1),
        v AS (SELECT *, 21.1::DOUBLE * f / ((12 * h * h * k + 2 * h * 248320) / (12 * 1024::BIGINT * 1024 * 24 + 2 * 1024 * 248320)) * 1.2::DOUBLE * CASE WHEN batch < 64 THEN pow(batch / 64, 0.25::DOUBLE) ELSE 1 END AS sps FROM c),
        w AS (SELECT *, (r_regionkey + 1) * 100000 * 3 / sps / 3600 AS hours FROM v)
      SELECT size, gpu, r_regionkey, batch::INT AS batch, round(vram, 4) AS vram, round(sps, 4) AS sps, round(hours, 4) AS hours, round(hours * r, 4) AS cost, greatest(1, ceil(floor(hours) / 24))::BIGINT AS jobs FROM w""",
} | records.ORACLE_SQL | files.ORACLE_SQL
