"""Folders that the driver and all executors share, and single files in them, through Spark's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path, in the one that the cluster names in ``spark.checkpoint.dir``; a session on one machine that names none uses a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="records-")
    return f"{named}/records-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Write one small file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path
