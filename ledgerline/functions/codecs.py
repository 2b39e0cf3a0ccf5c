"""Records as one line (cells between bars) or as a block of named lines; prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIELDS, TEXT_FIELDS
from .text import text, trim

#: A reply's fence of three back-ticks, with or without a language.
_FENCE = r"^```[a-zA-Z]*\n?|\n?```\s*$"


def cell(record: Column, field: str) -> Column:
    value = record[field]
    return F.when(F.coalesce(value, F.lit(False)), "True").otherwise("False") if field == "is_business" else text(value)


def to_pipe(record: Column) -> Column:
    return F.concat_ws("|", *[cell(record, f) for f in FIELDS])


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def to_yaml(record: Column) -> Column:
    lines = [F.concat(F.lit(f"{f}: "), cell(record, f) if f == "is_business" else quoted(cell(record, f))) for f in FIELDS]
    return F.concat_ws("\n", *lines)


def _record(cells: dict[str, Column]) -> Column:
    """Cells as text; is_business stays 'True', 'False' or ''."""
    return F.struct(*[cells[f].alias(f) for f in FIELDS])


def parse_pipe(line: Column) -> Column:
    """Short lines are filled up with '', more cells are ignored."""
    parts = F.split(text(line), r"\|")
    return _record({f: F.coalesce(trim(F.get(parts, F.lit(k))), F.lit("")) for k, f in enumerate(FIELDS)})


def parse_yaml(block: Column, unescape: bool = False) -> Column:
    """The first line of each key counts.  unescape: undo the writer's back-slashes, which the plain reading keeps."""

    def value(f):
        v = F.regexp_extract(text(block), rf'(?m)^[ \t]*{f}:[ \t]*"?(.*?)"?[ \t]*$', 1)
        return F.regexp_replace(v, r'\\(["\\])', "$1") if unescape else v

    return _record({f: value(f) for f in FIELDS})


def typed(record: Column) -> Column:
    """A parsed record with is_business as a boolean."""
    return F.struct(*[(F.lower(record[f]) == "true" if f == "is_business" else record[f]).alias(f) for f in FIELDS])


def empty_record() -> Column:
    return F.struct(*[(F.lit(False) if f not in TEXT_FIELDS else F.lit("")).alias(f) for f in FIELDS])


def user_prompt(context: Column, raw_line: Column) -> Column:
    known = lambda f: F.coalesce(context[f], F.lit("?"))
    return F.concat(F.lit("[publisher="), known("publisher"), F.lit("; year="), known("directory_year"), F.lit("] "), raw_line)


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))


def lines_of(column: Column) -> Column:
    """Lines; a final line end makes no further line, and Python's other line ends count too."""
    parts = F.split(column, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def unfenced(reply: Column) -> Column:
    return trim(F.regexp_replace(trim(text(reply)), _FENCE, ""))


def _pipe_line(plain: Column) -> Column:
    lines = lines_of(plain)
    return trim(F.coalesce(F.get(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), F.lit(0)), F.get(lines, F.lit(0)), F.lit("")))


def parse_response(reply: Column, target: str = "pipe") -> Column:
    """pipe: the first line with a bar, else the first line; yaml: all lines that aren't blank."""
    plain = unfenced(reply)
    return _pipe_line(plain) if target == "pipe" else F.array_join(F.filter(lines_of(plain), lambda x: trim(x) != ""), "\n")


def first_record(reply: Column, target: str = "yaml") -> Column:
    """As parse_response, but a block ends before a key's second line, or a line without key after its first.

    A fold over the lines keeps the keys seen, the lines taken, and whether the block has ended.
    """
    plain = unfenced(reply)
    if target == "pipe":
        return _pipe_line(plain)
    kept = F.filter(lines_of(plain), lambda x: trim(x) != "")
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("seen"), none.alias("taken"), F.lit(False).alias("over"))

    def step(s, line):
        key = F.regexp_extract(line, r"^\s*([a-z_]+):", 1)
        over = s["over"] | F.array_contains(s["seen"], key) | ((key == "") & (F.size(s["taken"]) > 0))
        take = ~over & (key != "")
        return F.struct(
            F.when(take, F.array_append(s["seen"], key)).otherwise(s["seen"]).alias("seen"),
            F.when(take, F.array_append(s["taken"], line)).otherwise(s["taken"]).alias("taken"), over.alias("over"),
        )

    return F.array_join(F.aggregate(kept, zero, step)["taken"], "\n")


def runs_away(completion: Column, markers: tuple[str, ...] = ("<|im_start|>", "<think>", "\nuser\n")) -> Column:
    """A completion that doesn't stop: it holds a marker of another turn, or names a second record."""
    hit = F.regexp_count(text(completion), F.lit("(?m)^name:")) > 1
    for m in markers:
        hit = hit | F.contains(text(completion), F.lit(m))
    return hit
