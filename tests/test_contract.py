"""The driver's contract: every query runs and matches its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans import queries as core

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in core.QUERIES])
def test_query(spark, sql, name):
    got = core.QUERIES[name](spark, D).toPandas()
    if name in core.ORACLE_SQL:
        assert rows(got) == rows(sql.sql(core.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


@pytest.mark.parametrize("name", ["text_files", "ocr_files"])
def test_volumes_in_several_files(spark, tmp_path, name):
    """Places go on from file to file when a volume's sort makes several; rows may also be repeated with other keys and the same names."""
    one = spark.read.parquet(f"{D}/customer.parquet")
    one.unionByName(one.withColumn("c_custkey", one.c_custkey + 1000)).write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = core.QUERIES[name](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert rows(got) == rows(c.sql(core.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    from ledgerline.sources.sinks import run_log
    from ledgerline.streaming import logs

    master, source = str(tmp_path / "master"), str(tmp_path / "in")
    spark.createDataFrame([("ia", "a"), ("ia", "b")], "source string, id string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("source string, id string").parquet(source)
        logs.merge_into(stream, master, str(tmp_path / f"c{_}")).awaitTermination()
    assert spark.read.parquet(master).count() == 2 and run_log
