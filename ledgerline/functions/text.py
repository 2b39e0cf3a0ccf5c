"""Text normalizers, tests and parsers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def rx(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def blank(column: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(trim(column), F.lit(""))


def trim(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def squeeze(column: Column) -> Column:
    """White space runs as single blanks, none at the ends; ``(?U)`` takes all Unicode white space."""
    return F.trim(F.regexp_replace(text(column), r"(?U)\s+", " "))


def squeeze_marks(column: Column) -> Column:
    """As squeeze, and without blanks, commas and full stops at the ends."""
    return F.btrim(squeeze(column), F.lit(" ,."))


def norm(column: Column, strict: bool = False) -> Column:
    """What scores compare: squeezed, without final full stops (taken off once, then trimmed), lower case."""
    return text(column) if strict else F.lower(F.trim(F.rtrim(squeeze(column), F.lit("."))))


def despace(column: Column) -> Column:
    return F.regexp_replace(F.lower(text(column)), "[^a-z0-9]", "")


def tokens(column: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(column)), F.lit("[a-z0-9]+"), F.lit(0)))


def truthy(column: Column, short: bool = False) -> Column:
    """true, 1, yes; short: also t."""
    return F.lower(trim(text(column))).isin("true", "1", "yes", *(["t"] if short else []))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def starts_upper(column: Column) -> Column:
    return rx(column, r"^\p{Lu}")


def safe_double(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


# ---------------------------------------------------------------- years, publishers, titles

# What counts as a year.
_YEAR = r"(1[789]\d{2}|20\d{2})"
# Known publishers, most specific first.
PUBLISHERS = ["Longworth", "Doggett", "Trow", "Lain", "Polk", "Sampson", "Boyd", "Wilson", "Goulding", "Franks", "Kollock", "Hodge", "Duncan", "Greenleaf"]
BOROUGHS = ["Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]
# Volumes kept for evaluation, as parts of publisher and year.
HELD_OUT = [("Trow", "1850"), ("Lain", "1897")]
REVIEW = "REVIEW: matches held-out eval signature — keep OUT of harvest set or confirm"


def parse_year(column: Column) -> Column:
    """'1875/76' from a range, else the first year, else ''."""
    pattern = rf"\b{_YEAR}\s*[/-]\s*(\d{{2,4}})\b"
    end = F.regexp_extract(column, pattern, 2)
    return F.when(end != "", F.concat(F.regexp_extract(column, pattern, 1), F.lit("/"), F.right(end, F.lit(2)))).otherwise(F.regexp_extract(column, rf"\b{_YEAR}\b", 1))


def year_number(column: Column) -> Column:
    return F.coalesce(F.regexp_extract(text(column), r"(\d{4})", 1).try_cast("int"), F.lit(0))


def decade(column: Column) -> Column:
    year = year_number(column)
    return F.when(year > 0, F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))).otherwise(F.lit("∅"))


def named(column: Column, names: list[str]) -> Column:
    """The names that occur in the text, in the list's order."""
    return F.filter(F.array(*map(F.lit, names)), lambda x: F.contains(F.lower(text(column)), F.lower(x)))


def parse_publisher(column: Column) -> Column:
    return F.coalesce(F.get(named(column, PUBLISHERS), F.lit(0)), F.lit(""))


def boroughs(column: Column) -> Column:
    return named(column, BOROUGHS)


def held_out(publisher: Column, year: Column) -> Column:
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(text(publisher)), F.lit(p.lower())) & F.contains(text(year), F.lit(y)) for p, y in HELD_OUT])
    return F.when(hit, F.lit(REVIEW)).otherwise(F.lit(""))


# Identifiers of collections.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def detect_source(url: Column) -> Column:
    """kind, ident and error of a URL or bare identifier; the first rule that matches decides."""
    u = trim(text(url))
    uuid, item = F.regexp_extract(u, f"({UUID})", 1), F.regexp_extract(u, r"archive\.org/(?:details|download)/([^/?#]+)", 1)

    def out(kind, ident, error=None):
        return F.struct(F.lit(kind).alias("kind"), ident.alias("ident"), F.lit(error).cast("string").alias("error"))

    none = F.lit(None).cast("string")
    return (
        F.when(F.contains(u, F.lit("loc.gov")), out("loc", u))
        .when(rx(u, r"digitalcollections\.nypl\.org|api-collections\.nypl\.org"), F.when(uuid != "", out("nypl", uuid)).otherwise(out(None, none, "no collection UUID")))
        .when(rx(u, f"^{UUID}$"), out("nypl", u))
        .when(F.contains(u, F.lit("archive.org")), F.when(item != "", out("ia", item)).otherwise(out(None, none, "no item identifier")))
        .when(F.startswith(u, F.lit("http")), out("iiif", u))
        .otherwise(out("ia", u))
    )


def publisher_slug(column: Column) -> Column:
    s = trim(F.split_part(F.lower(trim(text(column))), F.lit("/"), F.lit(1)))
    for pattern in (r"\b[a-z]\.\s*", r"'s\b", r"\b(directory|co|company|inc)\b\.?", "[^a-z]+"):
        s = F.regexp_replace(s, pattern, "")
    return s


# ---------------------------------------------------------------- names

# Names whose apostrophe the source lacks.
O_NAMES = [
    "OBRIEN", "OCONNOR", "ONEILL", "ONEIL", "OSULLIVAN", "ODONNELL", "OREILLY", "OHARA",
    "OCONNELL", "OKEEFE", "OKEEFFE", "OROURKE", "OMALLEY", "OLEARY", "OSHEA", "ODOHERTY",
    "OBOYLE", "ODONOGHUE", "OGRADY", "ODWYER", "OBYRNE", "OCALLAGHAN", "OFARRELL", "ODAY",
    "OLOUGHLIN", "OMARA", "OTOOLE", "OFLAHERTY", "ORIORDAN", "OGORMAN", "OKANE",
]


def capitalized(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substr(column, F.lit(2))))


def recase(column: Column) -> Column:
    u = F.upper(trim(column))
    return (
        F.when(u.isin(O_NAMES), F.concat(F.lit("O'"), capitalized(F.substr(u, F.lit(2)))))
        .when(F.startswith(u, F.lit("MC")) & (F.length(u) > 2), F.concat(F.lit("Mc"), capitalized(F.substr(u, F.lit(3)))))
        .otherwise(F.array_join(F.transform(F.split(u, "-"), capitalized), "-"))
    )


# Patterns of firm names, one for each kind of source.
FIRM_SCORED = r"\s&\s|\b(?:Co|Bros|Sons)\.?$"
FIRM_TAGGED = r"(?i)\bet\b|&|\bCie\b|\bfr[eè]res\b"
FIRM_LINES = r"(?i)&|\bCo\b|\bBros\b|\bestate of\b|\bSons\b"


def looks_firm_scored(name: Column) -> Column:
    """A firm's ending, or all capitals with a blank."""
    return rx(name, FIRM_SCORED) | ((F.upper(name) == name) & rx(name, r"\p{Lu}") & F.contains(name, F.lit(" ")))


def looks_firm_tagged(name: Column) -> Column:
    return rx(name, FIRM_TAGGED)


def looks_firm(name: Column) -> Column:
    return rx(name, FIRM_LINES)


def alpha_range(name: Column) -> Column:
    three = F.regexp_extract(name, "([A-Za-z]{3})", 1)
    return F.upper(F.when(three != "", three).otherwise(F.substring(name, 1, 3)))


def ordinal(n: Column) -> Column:
    """Period style: 1st 2d 3d 4th, 11th 12th 13th."""
    tail = F.when(F.pmod(n, F.lit(100)).isin(11, 12, 13), "th").when(F.pmod(n, F.lit(10)) == 1, "st").when(F.pmod(n, F.lit(10)).isin(2, 3), "d").otherwise("th")
    return F.concat(n.cast("string"), tail)


def xywh(fragment: Column) -> Column:
    return F.nullif(F.regexp_extract(text(fragment), r"#xywh=([\d.,]+)", 1), F.lit(""))


# Names of sample folders.
_DIR = r"nypl_([a-z]+)(?:_[a-z]+)*_(1[6789]\d\d)(?:_(\d\d))?_[0-9a-f]{8}$"


def parse_dir(name: Column) -> Column:
    """publisher and year of a sample folder's name; '' where it has another form."""
    tail = F.regexp_extract(name, _DIR, 3)
    year = F.concat(F.regexp_extract(name, _DIR, 2), F.when(tail != "", F.concat(F.lit("/"), tail)).otherwise(F.lit("")))
    return F.struct(F.regexp_extract(name, _DIR, 1).alias("publisher"), year.alias("year"))


# ---------------------------------------------------------------- line tests

# Words that mark a street.
STREET_WORDS = r"(?iU)\b(st|street|av|ave|avenue|lane|pl|place|road|rd|sq|square|row|slip|alley|wharf|dock|market|cor|corner)\b"


# Numbers of pages, in either numerals; lines of an OCR reading that are a number.
PAGE_NUMBER, LINE_NUMBER = r"^[\dIVXLC.\s-]+$", r"^\W*\d{1,4}\W*$"


def is_noise(line: Column) -> Column:
    """A page's headings and numbers rather than an entry."""
    return (F.length(line) < 6) | ~rx(line, r"\p{Ll}") | rx(line, PAGE_NUMBER)


def is_ocr_junk(line: Column) -> Column:
    ascii_share = F.try_divide(F.length(F.regexp_replace(line, r"[^\x00-\x7F]", "")), F.length(line))
    return (F.length(line) < 8) | rx(line, LINE_NUMBER) | ~rx(line, "[a-z]") | (F.coalesce(ascii_share, F.lit(0.0)) < 0.85)


def clean_occupation(column: Column) -> Column:
    """An occupation for the pool, or ''."""
    o = F.regexp_replace(F.btrim(trim(text(column)), F.lit(",;")), r"(?U)\s+", " ")
    low = F.lower(o)
    street = rx(o, STREET_WORDS) & ~F.contains(low, F.lit("house")) & ~F.contains(low, F.lit("store"))
    drop = (o == "") | (F.length(o) > 42) | F.contains(o, F.lit(":")) | rx(o, r"\d") | street | low.isin("do", "do.", "none", "n/a", "the", "and") | ~rx(o, "[a-z]")
    return F.when(drop, F.lit("")).otherwise(o)


def name_token(token: Column) -> Column:
    """A token that may be a name: two characters or more, without digits, not an initial."""
    bare = F.rtrim(token, F.lit("."))
    return (F.length(bare) >= 2) & ~rx(token, r"\d")


def complete_jpeg(content: Column) -> Column:
    return (F.length(content) >= 2000) & (F.hex(F.substring(content, -2, 2)) == "FFD9")


def split_first_comma(column: Column) -> tuple[Column, Column]:
    """Text before and after the first comma outside parentheses; the second is '' without one.

    A fold over the characters counts the open parentheses.
    """
    chars = F.split(text(column), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("at"))

    def step(s, c):
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        i = s["i"] + 1
        return F.struct(depth.alias("depth"), i.alias("i"), F.when((s["at"] == 0) & (c == ",") & (s["depth"] == 0), i).otherwise(s["at"]).alias("at"))

    at = F.aggregate(chars, zero, step)["at"]
    head = F.when(at > 0, F.substr(column, F.lit(1), at - 1)).otherwise(text(column))
    return head, F.when(at > 0, F.substr(column, at + 1)).otherwise(F.lit(""))
