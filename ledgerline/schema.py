"""The one place where record shapes are defined."""

from __future__ import annotations

from pyspark.sql import types as T

#: The eight fields of a record, in the order of its serialized forms.
FIELDS = ["name", "is_business", "spouse_name", "race_designation", "occupation_role", "employer", "address", "home_address"]
TEXT_FIELDS = [f for f in FIELDS if f != "is_business"]


def _strings(*names: str, nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), nullable) for n in names]


RECORD = T.StructType([T.StructField(f, T.BooleanType() if f == "is_business" else T.StringType(), False) for f in FIELDS])
#: page, image and source are there for some data sets only; ``dialect`` is retired, and checked for.
CONTEXT = T.StructType([*_strings("publisher", "alphabetical_range", "directory_year", "image"), T.StructField("page", T.IntegerType()), *_strings("source", "dialect")])
EXAMPLE = T.StructType([*_strings("raw_line"), T.StructField("context", CONTEXT), T.StructField("record", RECORD)])
CATALOG = [
    "source", "id", "publisher", "city", "borough", "year", "start_page", "end_page", "column_count", "sample_page", "key_page",
    "page_offset", "holding_institution", "contributing_institution", "title", "notes",
]
CATALOG_ROW = T.StructType(_strings(*CATALOG))
FIELD_METRICS = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("em", "p", "r", "f1")), T.StructField("gold_ne", T.LongType()), T.StructField("pred_ne", T.LongType()), T.StructField("applicable", T.BooleanType()), T.StructField("excluded", T.BooleanType())])
METRICS = T.StructType([
    *_strings("timestamp", "label", "gold", "pred"), T.StructField("strict", T.BooleanType()), T.StructField("n", T.LongType()),
    *(T.StructField(n, T.DoubleType()) for n in ("row_exact_pct", "macro_f1", "micro_f1")), T.StructField("fields_scored", T.LongType()),
    T.StructField("spurious_fields", T.ArrayType(T.StringType())), T.StructField("per_field", T.MapType(T.StringType(), FIELD_METRICS)),
    T.StructField("excluded_fields", T.ArrayType(T.StringType())),
])
POOL = T.StructType([*_strings("term"), T.StructField("count", T.LongType())])
_LOCATION = "ARRAY<STRUCT<value: STRING, labels: ARRAY<STRING>, label: STRING, score: STRING>>"
#: Flags and scores are numbers or text in the source: they are read as text.
SCORED_ENTRY = f"""complete_entry STRING, directory_year STRING, low_entry_caution STRING, labeled_widow STRING, labeled_black STRING,
labeled_entry STRUCT<subjects: ARRAY<STRING>, occupations: ARRAY<STRING>, locations: {_LOCATION}>,
corrected_entry STRUCT<subjects: ARRAY<STRING>, occupations: ARRAY<STRUCT<value: STRING, score: STRING>>, locations: {_LOCATION}>"""
TAGGED_ENTRY = "book STRING, page INT, " + ", ".join(f"text_ocr_{o} STRING, nested_ner_xml_{o} STRING, has_valid_ner_xml_{o} BOOLEAN" for o in ("ref", "pero", "tess"))
#: Both versions of the extraction pipeline's table.
ENTRIES = T.StructType(_strings(
    "image", "canvas_fragment", "alphabetical_range", "address", "is_business", "occupant_name", "street_name", "is_advertisement",
    "name", "spouse_name", "race_designation", "occupation_role", "employer", "surname", "given_name", "occupation",
))
ALIGNED = "lines ARRAY<STRUCT<canvas_fragment: STRING, gemini_text: STRING>>"
PAGE_OCR = "image_width INT, image_height INT, lines ARRAY<STRUCT<bbox: ARRAY<INT>, text: STRING, confidence: DOUBLE>>"
READ_PACKET = "id STRING, year STRING, dir STRING, total INT, p1 STRING, l1 INT, p2 STRING, l2 INT"
READ_RESULT = "listing_columns INT, page1_printed_page INT, page2_printed_page INT, looks_like_trow_listing BOOLEAN, confidence STRING, notes STRING"
