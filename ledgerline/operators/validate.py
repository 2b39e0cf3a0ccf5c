"""Rules for labelled examples; each broken rule is a row (file, line, severity, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rx, squeeze, text, tokens, trim
from ..schema import FIELDS, TEXT_FIELDS

# Known publishers of examples, and patterns of addresses, firms and residence marks.
PUBLISHERS = [
    "franks", "duncan", "longworth", "mercein", "ogden", "doggett", "rode", "trow", "hearne", "hopehenderson", "smith", "lain", "boyd", "upington", "polk", "mb", "davison", "bottin",
]
ADDRESS_WORD = (
    r"(?i)\b(h|r|bds|b|res|rear|cor|c|n|s|e|w|av|ave|avenue|st|street|pl|place|ter|terrace|"
    r"rd|road|sq|square|la|lane|ct|court|row|slip|wharf|al|alley|"
    r"hall|hook|market|mkt|house|exchange|bank|dock|park|do)\b\.?"
)
FIRM = r"(?i)&|\bco\b|\bbros\b|\bbro\b|\bsons\b|\bmfg\b|\bworks\b|\b& co\b|\bcompany\b"
JOB_IS_ADDRESS = r"\b(h|r|bds)\s+\d|\b\d+\s+[A-Z]"
HOME_MARK = r"^(?:(?:h|bds|b)\.?\s+\S|[hb]\d)"
HOME_MARK_UNSURE = r"^(?:r\.?\s+\S|r\d)"
DRIFT_FIELDS = ["name", "occupation_role", "address", "employer", "spouse_name"]
CONTEXT_KEYS = ["publisher", "alphabetical_range", "directory_year", "image"]


def drift(raw: Column, value: Column) -> Column:
    """Words of two characters or more that the raw line lacks."""
    return F.filter(F.array_except(tokens(value), tokens(raw)), lambda x: F.length(x) > 1)


def _finding(severity: str, rule: str, hit: Column, detail: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))


def record_rules(raw: Column, record: dict[str, Column]) -> list[Column]:
    """Rules on the record alone; its cells are text, is_business a boolean."""
    r = {f: record[f] if f == "is_business" else text(record[f]) for f in FIELDS}
    none, home = F.lit(None), r["home_address"]
    rules = [_finding("error", "empty_name", trim(r["name"]) == "", none)]
    rules += [_finding("error", "bar_or_newline", rx(r[f], r"[|\n]"), F.lit(f)) for f in TEXT_FIELDS]
    rules += [_finding("warning", "token_drift", F.size(drift(raw, r[f])) > 0, F.concat(F.lit(f"{f}: "), F.array_join(F.array_sort(drift(raw, r[f])), " "))) for f in DRIFT_FIELDS]
    return [
        *rules,
        _finding("warning", "occupation_is_address", rx(r["occupation_role"], JOB_IS_ADDRESS), r["occupation_role"]),
        _finding("warning", "odd_address", (trim(r["address"]) != "") & ~rx(r["address"], r"\d") & ~rx(r["address"], ADDRESS_WORD), r["address"]),
        _finding("warning", "home_without_address", (trim(home) != "") & (trim(r["address"]) == ""), home),
        _finding("error", "home_mark", rx(home, HOME_MARK), home),
        _finding("warning", "home_mark_unsure", ~rx(home, HOME_MARK) & rx(home, HOME_MARK_UNSURE), home),
        _finding("warning", "firm_not_business", rx(r["name"], FIRM) & ~F.coalesce(r["is_business"], F.lit(False)), r["name"]),
    ]


def findings(examples: DataFrame, file: str, line: str, rules: list[Column]) -> DataFrame:
    return examples.select(file, line, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select(file, line, "f.*")


def check_lines(lines: DataFrame, file: str = "file", line: str = "line", value: str = "value") -> DataFrame:
    """All findings of lines of JSON, with what only the raw form shows: bad JSON, missing and unknown keys, types."""
    d = lines.where(trim(F.col(value)) != "").withColumn("v", F.try_parse_json(value))
    has = lambda path: F.try_variant_get("v", path, "variant").isNotNull()
    as_text = lambda path: F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))
    d = d.withColumns({"record": F.from_json(F.try_variant_get("v", "$.record", "string"), "map<string,string>"), "context": F.from_json(F.try_variant_get("v", "$.context", "string"), "map<string,string>")})
    bad = F.col("v").isNull()
    parts = [F.coalesce(has(f"$.{p}"), F.lit(False)) for p in ("raw_line", "context", "record")]
    whole = ~bad & parts[1] & parts[2]
    keys = F.coalesce(F.map_keys("record"), F.array().cast("array<string>"))
    names = F.array(*map(F.lit, FIELDS))
    context_keys = F.coalesce(F.map_keys("context"), F.array().cast("array<string>"))
    year, publisher = as_text("$.context.directory_year"), as_text("$.context.publisher")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.record.is_business", "variant"))
    record = {f: as_text(f"$.record.{f}") for f in TEXT_FIELDS} | {"is_business": F.try_variant_get("v", "$.record.is_business", "boolean")}
    shape = [
        _finding("error", "invalid_json", bad, F.lit(None)),
        *[_finding("error", "missing_part", ~bad & ~p, F.lit(n)) for p, n in zip(parts, ("raw_line", "context", "record"))],
        _finding("error", "missing_field", whole & (F.size(F.array_except(names, keys)) > 0), F.array_join(F.array_sort(F.array_except(names, keys)), " ")),
        _finding("error", "unknown_field", whole & (F.size(F.array_except(keys, names)) > 0), F.array_join(F.array_sort(F.array_except(keys, names)), " ")),
        _finding("error", "business_not_boolean", whole & F.array_contains(keys, "is_business") & (F.coalesce(kind, F.lit("VOID")) != "BOOLEAN"), kind),
        *[_finding("error", "missing_context", whole & ~F.array_contains(context_keys, k), F.lit(k)) for k in CONTEXT_KEYS],
        _finding("error", "retired_context", whole & F.array_contains(context_keys, "dialect"), F.lit("dialect")),
        _finding("warning", "odd_year", whole & F.array_contains(context_keys, "directory_year") & ~rx(year, r"^\d{4}"), year),
        _finding("warning", "unknown_publisher", whole & F.array_contains(context_keys, "publisher") & ~publisher.isin(PUBLISHERS), publisher),
    ]
    rules = record_rules(as_text("$.raw_line"), record)
    return findings(d, file, line, shape + [F.when(whole, r) for r in rules])


def duplicates(rows: DataFrame, group: Column, line: Column, pos: str) -> DataFrame:
    """The second and later rows of the same group and squeezed line; lines meet by a hash of 128 bits."""
    w = Window.partitionBy(group, F.md5(squeeze(line).cast("binary"))).orderBy(pos)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def fill_rates(records: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """field, filled, n: true booleans and texts that aren't blank; one pass for all fields."""
    kinds = dict(records.dtypes)
    filled = lambda f: F.col(f) if kinds[f] == "boolean" else trim(text(F.col(f))) != ""
    one = records.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(filled(f), F.lit(False))).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("n").alias("n")) for f in fields])).alias("x")).select("x.*")


def thin(rows: DataFrame, image: str, least: int = 5) -> DataFrame:
    return rows.groupBy(image).agg(F.count("*").alias("n")).where(F.col("n") < least)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def shown(found: DataFrame, file: str, line: str, most: int = 200) -> DataFrame:
    """The first findings, errors before warnings."""
    return found.orderBy("severity", file, line, "rule").limit(most)


def failed(found: DataFrame, strict: bool = False) -> bool:
    """Whether a run should fail: any error, or any finding at all when strict."""
    return not (found if strict else found.where("severity = 'error'")).isEmpty()
