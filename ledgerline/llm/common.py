"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D.  ``bytes.split()`` without
#: an argument splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a session on one machine that names none (a
    test) gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows, and bytes on average, that are Python objects at a time.
SLICE, SLICE_BYTES = 1024, 4 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE rows, fewer if they are long, none empty."""
    for batch in batches:
        step = max(1, min(SLICE, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_hash() -> Column:
    """64 bits of the text, by which rows that share a doc_id are told apart; equal rows have equal hashes."""
    return F.xxhash64(F.col("text").cast("string"))


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """One output row for each input row; ``make`` gets a batch and returns columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(make.__module__)
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(make(batch))

    return df.mapInArrow(run, schema)


def text_only(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns, whatever else the table holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


#: How to drop what a module keeps in a Python worker from task to task; and the module that ran last.
_FORGET: dict[str, Callable[[], None]] = {}
_RAN: list[str] = [""]


def forgets(module: str, drop: Callable[[], None]) -> None:
    """Register how to drop the module's memo."""
    _FORGET[module] = drop


def alone(module: str) -> None:
    """A task of ``module`` begins here: drop the memos of other modules, as a worker outlives its stage."""
    if _RAN[0] != module:
        _RAN[0] = module
        for other, drop in _FORGET.items():
            if other != module:
                drop()
        pa.default_memory_pool().release_unused()


class Seen(dict):
    """A bounded memo: forgets everything when full, so memory doesn't follow the data."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
