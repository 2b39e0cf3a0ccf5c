"""Label sets of other shapes, turned into examples (raw_line, context, record)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    alpha_range, blank, despace, is_noise, looks_firm, looks_firm_scored, looks_firm_tagged, rx, split_first_comma, squeeze, squeeze_marks, text, trim, truthy, xywh,
)
from ..schema import FIELDS


def example(raw_line: Column, context: dict[str, Column], record: dict[str, Column]) -> list[Column]:
    """The three columns of an example; fields that aren't named are empty."""
    full = {f: F.lit(False) if f == "is_business" else F.lit("") for f in FIELDS} | record
    return [raw_line.alias("raw_line"), F.struct(*[v.alias(k) for k, v in context.items()]).alias("context"), F.struct(*[full[f].alias(f) for f in FIELDS]).alias("record")]


def drop_counts(rows: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """How many rows were kept (null reason) or dropped, and why."""
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- entries with scored corrections


def scores_ok(block: Column, least: int = 15) -> Column:
    """Every score of occupations and locations is a number of at least ``least``; a missing block fails."""
    if least <= 0:
        return F.lit(True)
    fine = lambda xs: F.forall(F.coalesce(xs, F.array()), lambda x: F.coalesce(F.coalesce(x["score"], F.lit("0")).try_cast("int") >= least, F.lit(False)))
    return block.isNotNull() & fine(block["occupations"]) & fine(block["locations"])


def locations(block: Column) -> Column:
    """address and home: the first place labelled ``h`` is home, the first other one (or a second ``h``) the
    address; a home without address is the address."""
    is_home = lambda x: F.array_contains(F.coalesce(x["labels"], F.array(x["label"])), "h")
    zero = F.struct(F.lit("").alias("address"), F.lit("").alias("home"))

    def step(s, x):
        value = trim(text(x["value"]))
        home = F.coalesce(is_home(x), F.lit(False)) & (s["home"] == "")
        return F.struct(F.when(~home & (s["address"] == ""), value).otherwise(s["address"]).alias("address"), F.when(home, value).otherwise(s["home"]).alias("home"))

    got = F.aggregate(F.filter(F.coalesce(block["locations"], F.array()), lambda x: trim(text(x["value"])) != ""), zero, step)
    lone = (got["address"] == "") & (got["home"] != "")
    return F.struct(F.when(lone, got["home"]).otherwise(got["address"]).alias("address"), F.when(lone, F.lit("")).otherwise(got["home"]).alias("home"))


# How widows and race are marked in a line.
WIDOW = r"\bwid(?:ow)?\b\.?\s+(?:of\s+)?([A-Z][A-Za-z'.\- ]*?)(?=[,.]|\s+(?:h\.|r\.|\d)|$)"
RACE = r"(?i)\b(col'd|colored|col)\b"


def widow(line: Column) -> Column:
    name = trim(F.regexp_extract(line, WIDOW, 1))
    return F.when(name != "", F.concat(F.lit("wid "), name)).otherwise(F.lit("wid"))


def from_scored(entries: DataFrame, corrected: bool = True, least_score: int = 15) -> DataFrame:
    """Examples and drop_reason; tests in the order caution, score, name, address."""
    block = F.col("corrected_entry" if corrected else "labeled_entry")
    subjects = F.coalesce(F.col("labeled_entry.subjects"), F.col("corrected_entry.subjects"), F.array())
    subjects = F.when(F.size(subjects) > 0, subjects).otherwise(F.coalesce(F.col("corrected_entry.subjects"), F.array()))
    joined = lambda xs, sep: trim(F.array_join(F.transform(F.filter(xs, lambda x: F.coalesce(x != "", F.lit(False))), trim), sep))
    jobs = F.transform(F.coalesce(block["occupations"], F.array()), lambda o: o["value"]) if corrected else F.coalesce(block["occupations"], F.array())
    line = text(F.col("complete_entry"))
    found = F.regexp_extract(line, RACE, 1)
    d = entries.withColumns({"_name": joined(subjects, " "), "_job": joined(jobs, ", "), "_at": locations(block)})
    reason = (
        F.when(F.coalesce(F.col("low_entry_caution"), F.lit("0")) == "1", "caution")
        .when(~scores_ok(F.col("corrected_entry"), least_score), "score").when(F.col("_name") == "", "name").when(F.col("_at.address") == "", "address")
    )
    record = {
        "name": F.col("_name"), "is_business": looks_firm_scored(F.col("_name")), "occupation_role": F.col("_job"), "address": F.col("_at.address"), "home_address": F.col("_at.home"),
        "spouse_name": F.when(text(F.col("labeled_widow")) == "1", widow(line)).otherwise(F.lit("")),
        "race_designation": F.when(text(F.col("labeled_black")) == "1", F.when(found != "", found).otherwise(F.lit("col"))).otherwise(F.lit("")),
    }
    context = {"publisher": F.lit("doggett"), "alphabetical_range": alpha_range(F.col("_name")), "directory_year": text(F.col("directory_year"))}
    return d.select(*example(line, context, record), reason.alias("drop_reason"))


# ---------------------------------------------------------------- entries with tags


def tagged(xml: Column, tag: str) -> Column:
    """The texts inside each <tag>, without tags of their own, squeezed and not empty."""
    inner = F.regexp_extract_all(text(xml), F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(inner, lambda x: squeeze(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")


def from_tagged(entries: DataFrame, ocr: str = "ref") -> DataFrame:
    """Examples and drop_reason; ocr: which reading of the page is used."""
    xml, line = F.col(f"nested_ner_xml_{ocr}"), F.col(f"text_ocr_{ocr}")
    valid = F.coalesce(F.col(f"has_valid_ner_xml_{ocr}"), F.lit(True)) if f"has_valid_ner_xml_{ocr}" in entries.columns else F.lit(True)
    d = entries.withColumns({"_name": F.array_join(tagged(xml, "PER"), " "), "_job": F.array_join(tagged(xml, "ACT"), ", "), "_at": F.array_join(tagged(xml, "SPAT"), "; ")})
    reason = F.when(~valid, "invalid").when((text(xml) == "") | (text(line) == ""), "empty").when(F.col("_name") == "", "name").when((F.col("_job") == "") & (F.col("_at") == ""), "address")
    record = {"name": F.col("_name"), "is_business": looks_firm_tagged(F.col("_name")), "occupation_role": F.col("_job"), "address": F.col("_at")}
    context = {"publisher": F.lit("bottin"), "alphabetical_range": F.lit(""), "directory_year": text(F.col("book")), "page": F.col("page")}
    return d.select(*example(squeeze(line), context, record), reason.alias("drop_reason"))


# ---------------------------------------------------------------- lines of a page, surnames carried forward

# Titles, and given names after which a line continues the run of its surname.
TITLES = ["Mrs", "Miss", "Mr", "Rev", "Dr", "Capt", "Col", "Gen", "Prof", "Hon"]
GIVEN = [
    "John", "William", "James", "Charles", "George", "Henry", "Patrick", "Michael", "Thomas",
    "Edward", "Frederick", "Joseph", "Samuel", "Frank", "Jacob", "Peter", "Daniel", "Robert",
    "Walter", "Earl", "Lester", "Leonard", "Otis", "Clarence", "Roy", "Ernest", "Louis", "Paul",
    "Noah", "Rudolph", "Ira", "Judson", "Lawrence", "Nereus", "Albert", "Arthur", "Harry",
    "Mary", "Margaret", "Catherine", "Anna", "Elizabeth", "Sarah", "Ellen", "Hannah", "Julia",
    "Emma", "Jane", "Carrie", "Ada", "Fannie", "Nettie", "Laura", "Jennie", "Juliette", "Lella",
    "Mabelle", "Myra", "Nora", "Bessie", "Pearl", "Hattie", "Lula", "Grace", "Florence", "Alice",
]
# How a clause with a residence starts, and what marks an address.
RESIDENCE = r"(?i)^(rms|bds|res|rear|r|b|h)\b"
ADDRESS = r"(?i)\d|\b(av|ave|st|bldg|cor|flat|blk|ter|pl|sq|blvd|road|rd|home)\b"


def carried_forward(lines: DataFrame, page: str, pos: str, head: Column, starts: Column) -> Column:
    """The head of the last line of the page, this one included, that starts a run."""
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(starts, head), ignorenulls=True).over(w)


def _words(column: Column) -> Column:
    return F.filter(F.split(column, r"(?U)\s+"), lambda x: x != "")


def _after(words: Column, n: Column | int) -> Column:
    return F.slice(words, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.greatest(F.size(words), F.lit(1)))


def from_lines(lines: DataFrame, page: str = "page", pos: str = "pos", line: str = "line", surname: str | None = None) -> DataFrame:
    """Examples of pages' lines in order; page and pos stay.  surname: all lines belong to this one."""
    d = lines.withColumn("_line", trim(F.col(line))).where(~is_noise(F.col("_line")))
    seg, rest = split_first_comma(F.col("_line"))
    d = d.withColumns({"_seg": seg, "_rest": rest})
    wid = F.regexp_extract("_seg", r"(?i)\(wid\s+([^)]+)\)", 1)
    d = d.withColumn("_spouse", F.when(wid != "", F.concat(F.lit("wid "), squeeze_marks(wid))).otherwise(F.lit("")))
    d = d.withColumn("_words", _words(squeeze_marks(F.when(wid != "", F.regexp_replace("_seg", r"(?i)\(wid\s+([^)]+)\)", "")).otherwise(F.col("_seg")))))
    lead = F.btrim(F.coalesce(F.get("_words", F.lit(0)), F.lit("")), F.lit("."))
    d = d.withColumn("_title", F.when(lead.isin(TITLES), F.get("_words", F.lit(0))).otherwise(F.lit("")))
    d = d.withColumn("_words", F.when(F.col("_title") != "", _after(F.col("_words"), 1)).otherwise(F.col("_words"))).where(F.size("_words") > 0)
    d = d.withColumn("_head", F.btrim(F.get("_words", F.lit(0)), F.lit(".")))
    if surname:
        d = d.withColumn("_surname", F.lit(surname)).withColumn("_given", F.when(F.col("_head") == surname, _after(F.col("_words"), 1)).otherwise(F.col("_words")))
    else:
        first = F.row_number().over(Window.partitionBy(page).orderBy(pos)) == 1
        goes_on = F.col("_head").isin(GIVEN) | rx(F.col("_head"), r"^\p{L}$")
        d = d.withColumn("_starts", first | ~goes_on)
        d = d.withColumn("_surname", carried_forward(d, page, pos, F.col("_head"), F.col("_starts")))
        d = d.withColumn("_given", F.when(F.col("_starts"), _after(F.col("_words"), 1)).otherwise(F.col("_words")))
    parts = F.concat(F.array("_surname"), F.when(F.col("_title") != "", F.array("_title")).otherwise(F.array().cast("array<string>")), F.col("_given"))
    d = d.withColumn("_name", squeeze_marks(F.array_join(parts, " ")))
    clauses = F.filter(F.transform(F.split(F.rtrim(F.col("_rest"), F.lit(". ")), ","), trim), lambda x: x != "")
    d = d.withColumn("_clauses", clauses)
    at = F.array_max(F.filter(F.transform("_clauses", lambda c, i: F.when(rx(c, RESIDENCE), i)), lambda i: i.isNotNull()))
    d = d.withColumn("_at", F.coalesce(at, F.lit(-1)))
    d = d.withColumn("_home", F.coalesce(F.get("_clauses", F.greatest("_at", F.lit(0))), F.lit("")))
    d = d.withColumn("_home", F.when(F.col("_at") >= 0, F.col("_home")).otherwise(F.lit("")))
    d = d.withColumn("_others", F.filter("_clauses", lambda c, i: i != F.col("_at")))
    first_words = _words(F.coalesce(F.get("_others", F.lit(0)), F.lit("")))
    d = d.withColumn("_first", first_words)
    job_word = lambda w: rx(w, r"^\p{Ll}") & ~rx(w, ADDRESS)
    stop = F.array_position(F.transform("_first", job_word), False)
    n = F.when(stop > 0, stop - 1).otherwise(F.size("_first")).cast("int")
    d = d.withColumn("_job", F.array_join(F.slice("_first", F.lit(1), n), " ")).withColumn("_left", F.array_join(_after(F.col("_first"), n), " "))
    bucket = F.filter(F.concat(F.array("_left"), _after(F.col("_others"), 1)), lambda x: x != "")
    d = d.withColumn("_bucket", bucket)
    work = F.array_join(F.filter("_bucket", lambda c: rx(c, ADDRESS)), " ")
    d = d.withColumn("_work", squeeze_marks(work)).withColumn("_employer", squeeze_marks(F.array_join(F.filter("_bucket", lambda c: ~rx(c, ADDRESS)), " ")))
    has_work = F.col("_work") != ""
    record = {
        "name": F.col("_name"), "is_business": looks_firm(F.col("_name")), "spouse_name": F.col("_spouse"), "occupation_role": squeeze_marks(F.col("_job")), "employer": F.col("_employer"),
        "address": F.when(has_work, F.col("_work")).otherwise(squeeze_marks(F.col("_home"))), "home_address": F.when(has_work, squeeze_marks(F.col("_home"))).otherwise(F.lit("")),
    }
    context = {"publisher": F.lit("davison"), "alphabetical_range": alpha_range(F.col("_name")), "directory_year": F.lit(""), "source": F.col(page).cast("string")}
    out = d.select(page, pos, *example(F.col("_line"), context, record))
    # Lines without address have set the surname; only now they go.
    return out.where((F.col("record.name") != "") & (F.col("record.address") != ""))


# ---------------------------------------------------------------- entries aligned to page lines


def is_person(row: DataFrame) -> Column:
    """A row with name and address, no occupant or street entry, no advertisement."""
    name = entry_name()
    return (name != "") & (trim(text(F.col("address"))) != "") & (trim(text(F.col("occupant_name"))) == "") & (trim(text(F.col("street_name"))) == "") & ~truthy(F.col("is_advertisement"))


def entry_name() -> Column:
    whole = F.concat_ws(" ", blank(F.col("surname")), blank(F.col("given_name")))
    return F.coalesce(blank(F.col("name")), whole, F.lit(""))


def entry_record() -> dict[str, Column]:
    plain = lambda c: F.coalesce(blank(F.col(c)), F.lit(""))
    return {
        "name": entry_name(), "is_business": truthy(F.col("is_business")), "spouse_name": plain("spouse_name"), "race_designation": plain("race_designation"),
        "occupation_role": F.coalesce(blank(F.col("occupation_role")), blank(F.col("occupation")), F.lit("")), "employer": plain("employer"), "address": plain("address"),
    }


def recoverable(raw: Column, *parts: Column) -> Column:
    """Every part occurs in the raw line when only letters and digits count."""
    ok = F.lit(True)
    for p in parts:
        ok = ok & F.contains(despace(raw), despace(p))
    return ok


def owned_text(lines: DataFrame, group: str, pos: str, line: str, owner: str) -> DataFrame:
    """Each owner with the text of its lines: from the one where it stands up to the next owner's.

    lines: group, pos, line and ``owner`` (null where no entry starts).  Lines before the first owner are dropped.
    """
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumn("_owner", F.last(owner, ignorenulls=True).over(w)).where("_owner is not null")
    parts = F.array_sort(F.collect_list(F.when(trim(text(F.col(line))) != "", F.struct(F.col(pos).alias("pos"), trim(F.col(line)).alias("text")))))
    return d.groupBy(group, F.col("_owner").alias(owner)).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def from_aligned(entries: DataFrame, lines: DataFrame, year: str = "", publisher: str = "", check: bool = True) -> DataFrame:
    """Examples of entries whose page lines are known.

    entries: the pipeline's rows and ``pos``; lines: image, pos, fragment, text, one row for each line of a page.
    An entry whose fragment isn't on its page bounds no interval; of entries at one line the last keeps it.
    """
    e = entries.where(is_person(entries)).withColumn("_key", xywh(F.col("canvas_fragment"))).where("_key is not null")
    at = lines.withColumn("_key", xywh(F.col("fragment"))).where("_key is not null").groupBy("image", "_key").agg(F.max("pos").alias("_line"))
    record = F.struct(*[c.alias(f) for f, c in entry_record().items()])
    e = e.join(at, ["image", "_key"]).select("image", "_line", F.struct(F.col("pos").alias("pos"), record.alias("record"), text(F.col("alphabetical_range")).alias("range")).alias("entry"))
    e = e.groupBy("image", "_line").agg(F.max_by("entry", F.col("entry.pos")).alias("entry"))
    own = lines.join(e.withColumnRenamed("_line", "pos"), ["image", "pos"], "left").withColumn("_starts", F.when(F.col("entry").isNotNull(), F.col("pos")))
    texts = owned_text(own.select("image", "pos", "text", "_starts"), "image", "pos", "text", "_starts")
    d = texts.join(e, (texts["image"] == e["image"]) & (texts["_starts"] == e["_line"])).select(texts["image"], "text", "entry").where("text <> ''")
    if check:
        d = d.where(recoverable(F.col("text"), F.col("entry.record.name"), F.col("entry.record.address")))
    context = {"publisher": F.lit(publisher), "alphabetical_range": F.col("entry.range"), "directory_year": F.lit(year), "image": F.col("image")}
    return d.select(F.col("entry.pos").alias("pos"), *example(F.col("text"), context, {f: F.col(f"entry.record.{f}") for f in entry_record()}))


def pseudo_gold(lines: DataFrame, line: str = "line", publisher: str = "trow", year: str = "1850") -> DataFrame:
    """Lines with an empty record, for a model to fill."""
    known = lambda c, default: F.coalesce(blank(F.col(c)), F.lit(default)) if c in lines.columns else F.lit(default)
    return lines.select(*example(F.col(line), {"publisher": known("publisher", publisher), "alphabetical_range": F.lit(""), "directory_year": known("year", year)}, {}))


def imported_record(v: Column) -> Column:
    """A record from JSON (a VARIANT) whose fields may be missing, null or of another type: absent text is '', and
    is_business is true for what isn't empty, zero, false or null."""
    one = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.is_business", "variant")), F.lit("VOID"))
    number = F.try_variant_get(v, "$.is_business", "double")
    firm = F.when(kind == "VOID", F.lit(False)).when(kind == "BOOLEAN", one("is_business") == "true").when(kind == "STRING", one("is_business") != "").when(number.isNotNull(), number != 0).otherwise(F.lit(True))
    return F.struct(*[(F.coalesce(firm, F.lit(False)) if f == "is_business" else text(one(f))).alias(f) for f in FIELDS])
