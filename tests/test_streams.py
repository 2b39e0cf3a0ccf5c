"""Streams of run logs, keyed rows and event counts; and fetching over http."""

import threading
from datetime import datetime, timedelta
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from ledgerline.schema import METRICS
from ledgerline.sources import readers
from ledgerline.sources.sinks import run_log
from ledgerline.streaming import logs


def collected(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_last_runs_of_a_growing_log(spark, tmp_path):
    def row(k, gold, macro):
        return spark.range(1).select(*[{"timestamp": F.lit(f"2024-01-{k:02}"), "label": F.lit("m"), "gold": F.lit(gold), "macro_f1": F.lit(macro)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METRICS])

    for k, (gold, macro) in enumerate([("a", 0.1), ("b", 0.5), ("a", 0.3)], 1):
        run_log(row(k, gold, macro), str(tmp_path / "log"))
    got = collected(logs.last_runs(logs.run_log(spark, str(tmp_path / "log"))), "last_runs", "complete")
    assert {r.gold: r.macro_f1 for r in got.collect()} == {"a": 0.3, "b": 0.5}


@pytest.fixture
def events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=10 * k), f"k{k % 3}") for k in range(30)] + [(99, start + timedelta(days=9), "k0")]
    spark.createDataFrame(rows, "id int, ts timestamp, key string").coalesce(1).write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema("id int, ts timestamp, key string").parquet(str(tmp_path / "events"))


def test_rows_once_within_a_time(events):
    got = collected(logs.once(events, "ts", ["key"], "1 hour"), "once", "append").collect()
    assert {r.key for r in got} == {"k0", "k1", "k2"} and len(got) < 31


def test_counts_by_window(events):
    got = collected(logs.windowed_counts(events, "ts", "key", "1 hour", "1 day"), "windows", "append").collect()
    assert sum(r.n for r in got) == 30 and all(r.n == 2 for r in got)


class Page(BaseHTTPRequestHandler):
    asked = []

    def do_GET(self):
        Page.asked.append(self.path)
        ok = len(Page.asked) > 1
        self.send_response(200 if ok else 503)
        self.end_headers()
        self.wfile.write(b"one\ntwo" if ok else b"busy")

    def log_message(self, *_):
        pass


def test_http_texts_are_fetched_and_tried_again(spark, tmp_path, monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(readers, "download", partial(readers.download, wait=0))
    try:
        got = readers.whole_text(spark, f"http://127.0.0.1:{server.server_port}/a/page.txt?x=1", str(tmp_path)).collect()
    finally:
        server.shutdown()
    assert [r.value for r in got] == ["one\ntwo"] and got[0].file.endswith("/page.txt") and len(Page.asked) == 2
    with pytest.raises(ValueError):
        readers.whole_text(spark, "hf://a/b")
