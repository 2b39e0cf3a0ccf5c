"""Readers.  Order that the data hold only by place becomes columns: file and pos."""

from __future__ import annotations

import csv
import io
import time
import urllib.parse
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import parse_pipe, parse_yaml
from ..functions.text import is_ocr_junk, parse_dir, trim
from ..schema import ALIGNED, EXAMPLE, PAGE_OCR, SCORED_ENTRY, TAGGED_ENTRY
from .scratch import folder, put


def download(spark: SparkSession, uri: str, at: str, tries: int = 3, wait: float = 1.5) -> str:
    """The path of an http resource's copy in the folder ``at``; it is tried again after growing waits."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(uri, timeout=120) as f:
                return put(spark, f"{at}/{urllib.parse.urlsplit(uri).path.rsplit('/', 1)[-1] or 'resource'}", f.read())
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * (k + 1))


def local_copy(uri: str, folder: str, fetch=None) -> str:
    """A path Spark can read: the URI itself, or what ``fetch(uri, folder)`` stored for http and hub URIs."""
    if uri.split("://")[0] not in ("http", "https", "hf"):
        return uri
    if fetch is None:
        raise ValueError(f"{uri} is remote: give a function that fetches it")
    return fetch(uri, folder)


def _fetching(spark: SparkSession, uri: str, fetch):
    """The caller's function, or ``download`` for http; hub URIs need the caller's, as they need its client."""
    return fetch or ((lambda u, at: download(spark, u, at or folder(spark))) if uri.startswith("http") else None)


def json_lines(spark: SparkSession, path: str, schema=EXAMPLE) -> DataFrame:
    """Lines of JSON; blank ones are skipped, broken ones end the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def examples(spark: SparkSession, uri: str, at: str = "", fetch=None) -> DataFrame:
    return json_lines(spark, local_copy(uri, at, _fetching(spark, uri, fetch)))


def records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path).select("record.*")


def whole_text(spark: SparkSession, uri: str, at: str = "", fetch=None) -> DataFrame:
    return spark.read.text(local_copy(uri, at, _fetching(spark, uri, fetch)), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def tolerant_json(lines: DataFrame, value: str, schema: str) -> DataFrame:
    """Parsed lines; ``_corrupt`` holds a line that isn't JSON of that shape.  Blank lines are skipped."""
    # String fields also take numbers, so flags and scores come as text whatever they were.
    parsed = F.from_json(F.col(value), f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(trim(F.col(value)) != "").withColumn("_p", parsed)


def scored_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries, and the number of lines read and of broken ones."""
    d = tolerant_json(spark.read.text(path), "value", SCORED_ENTRY)
    return d.where("_p._corrupt is null").select("_p.*").drop("_corrupt"), corrupt_tally(d)


def corrupt_tally(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("read"), F.count_if(F.col("_p._corrupt").isNotNull()).alias("bad"))


def tagged_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAGGED_ENTRY).option("multiLine", True).json(path)


def _placed(files: DataFrame, whole: F.Column) -> DataFrame:
    """file, pos and line of a text reader's rows; a line's place is that in its ``whole``, a file or several in order of their paths.

    The rows are taken twice, as lines and as counts, by the same splits: Spark makes splits anew for each scan, and by
    the files that a filter leaves to that, so the scan's RDD is made once, and filters don't reach through it.
    """
    d = files.select("file", F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_read"), F.col("value").alias("line"))
    d = DataFrame(d.sparkSession._jsparkSession.createDataFrame(d._jdf.javaRDD(), d._jdf.schema()), d.sparkSession)
    splits = d.groupBy("file", "_split").agg(F.count("*").alias("_n"))
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))  # paths come encoded, but for +
    before = F.sum("_n").over(Window.partitionBy(whole).orderBy(path, "_split")) - F.col("_n")
    within = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_read")) - 1
    d = d.withColumn("_within", within).join(splits.withColumn("_before", before), ["file", "_split"])
    return d.select("file", (F.col("_before") + F.col("_within")).cast("int").alias("pos"), "line")


def _text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).withColumn("file", F.col("_metadata.file_path"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, pos and line of text files, read in splits; line ends are \\n, \\r\\n or \\r.

    Splits of a file are in order of where they begin, and lines of a split in the order in which they are read; so a
    line's place is the number of lines of the splits before, a small table, and its number within its split.
    """
    return _placed(_text(spark, paths), F.col("file"))


def _in_files(parts: DataFrame) -> DataFrame:
    """parts (file, pos, block) with row_id: their number over all files in order of path."""
    counts = parts.groupBy("file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file")) - F.col("_n")  # a row for each file
    rank = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return parts.withColumn("_rank", rank).join(counts.withColumn("_before", before), "file").select((F.col("_before") + F.col("_rank")).cast("long").alias("row_id"), "block")


def predictions(spark: SparkSession, path: str, target: str = "yaml", keep_blank: bool = False) -> DataFrame:
    """row_id and the parsed record of each line or block of a file, or of a folder's files in order of their names.

    Blank blocks are dropped and later ones move up, unless keep_blank; that keeps rows in their places.  Blocks are
    read a file at a time, as what separates them may have any number of blank lines.
    """
    if target == "pipe":
        parts, parse = numbered_lines(spark, path).withColumnRenamed("line", "block"), parse_pipe
    else:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        parts, parse = whole.select("file", F.posexplode(F.split("value", "\n\n" if keep_blank else r"\n\s*\n")).alias("pos", "block")), parse_yaml
    if not keep_blank:
        parts = parts.where(trim(F.col("block")) != "")
    return _in_files(parts).select("row_id", parse(F.col("block")).alias("r")).select("row_id", "r.*")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between empty lines, exactly two line ends."""
    return spark.read.text(path, lineSep="\n\n").withColumnRenamed("value", "block")


def csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table with a header, all columns text; columns that it lacks are null.

    Only the header line is looked at beforehand, as files differ in their columns.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    d = reader.option("inferSchema", False).csv(path)
    return d if columns is None else d.select(*[(F.col(c) if c in d.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def key_set(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a catalog; a missing file has none."""
    from ..operators.catalog import keys

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return keys(csv_rows(spark, path)) if there else spark.createDataFrame([], "_source string, _id string")


def worklist_ids(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path).where(trim(F.col("id")) != "").select(trim(F.col("id")).alias("id")).distinct()


def pool(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """term and count; not strict: lines of another form are dropped."""
    d = spark.read.schema("term STRING, count STRING").option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    n = trim(F.col("count"))
    d = d.select("term", (n.cast("long") if strict else n.try_cast("long")).alias("count"))
    return d if strict else d.where("count is not null and term is not null")


def csv_in_zip(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """The named columns of a table inside a zip archive; the one task that reads it finds them in its header."""

    def unpack(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)).open(member) as f:
                    rows = csv.reader(io.TextIOWrapper(f, "utf-8"))
                    head = next(rows, [])
                    at = [head.index(c) if c in head else None for c in columns]
                    while part := [r for _, r in zip(range(10_000), rows)]:
                        yield pd.DataFrame([[r[k] if k is not None and k < len(r) else None for k in at] for r in part], columns=columns, dtype=object)

    rows = spark.read.format("binaryFile").load(path).select("content")
    return rows.mapInPandas(unpack, ", ".join(f"`{c}` string" for c in columns))


def text_lines(spark: SparkSession, paths: str | list[str], exclude: str = "template", by: str = "file") -> DataFrame:
    """file, pos, line of text files, but for those with a certain word in their name.

    By "folder", a folder's files in order of their names are one text, and pos is a line's place in that.
    """
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    whole = {"file": F.col("file"), "folder": F.regexp_replace("file", "/[^/]*$", "")}[by]
    return _placed(_text(spark, paths).where(~F.contains(name, F.lit(exclude))), whole)


def ocr_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines worth reading, with publisher and year from the folder's name."""
    d = text_lines(spark, paths)
    d = d.withColumn("line", trim(F.col("line"))).where(~is_ocr_junk(F.col("line")))
    return d.withColumn("volume", F.element_at(F.split("file", "/"), -2)).select("file", "pos", "line", parse_dir(F.col("volume")).alias("_v")).select("file", "pos", "line", "_v.*")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of files below a folder; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


#: Images that were made from a page's own.
DERIVED = r"(_viz|_left|_right)\.jpg$"


def page_images(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path, "*.jpg").where(~F.col("path").rlike(DERIVED))


def pick_entries(files: DataFrame, path: str = "path") -> DataFrame:
    """For each folder its entries table: the first by name, of plain names before variants."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    variant = name.rlike(r"_v\d+|fixed|bak|geocoded|cleaned")
    return files.where(name.rlike(r"^entries_.*\.csv$")).groupBy(folder.alias("folder")).agg(F.min_by(path, F.struct(variant, F.col(path))).alias(path))


def aligned_lines(spark: SparkSession, path: str) -> DataFrame:
    """image, pos, fragment, text of aligned page files; the image is the name up to the second last part."""
    d = spark.read.schema(ALIGNED).option("multiLine", True).json(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "lines")
    image = F.regexp_replace("name", r"_[^_]*_aligned\.json$", "")
    return d.select(image.alias("image"), F.posexplode("lines").alias("pos", "l")).select("image", "pos", F.col("l.canvas_fragment").alias("fragment"), F.col("l.gemini_text").alias("text"))


def page_ocr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_OCR).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "*")


def pages_with_images(ocr: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages joined with their image by folder and stem, and pages without one."""
    stem = lambda c, tail: F.regexp_replace(c, tail, "")
    left, right = ocr.withColumn("_stem", stem(F.col("file"), r"(_surya)?\.json$")), images.withColumn("_stem", stem(F.col("path"), r"\.jpe?g$"))
    return left.join(right, "_stem").drop("_stem"), left.join(right.select("_stem"), "_stem", "left_anti").drop("_stem")


def not_done(inputs: DataFrame, outputs: DataFrame, on: str) -> DataFrame:
    return inputs.join(outputs.select(on).distinct(), on, "left_anti")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a stated order."""
    return df.orderBy(*order).limit(n)


