"""Places where a model is plugged in: a function of a batch of rows, run once a task with its model loaded."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def predict(rows: DataFrame, load: Callable[[], Callable[[list[dict]], list[str]]], key: str = "row_id", tries: int = 4, wait: float = 1.0, batch: int = 32) -> DataFrame:
    """key, prediction, status of each row.

    ``load`` makes the model once a task; it maps a list of rows to texts.  A batch that fails is tried again with
    growing waits, then row by row; a row that still fails has an empty prediction, so that places never shift.
    """

    def attempt(model, part: list[dict]) -> list[str] | None:
        for k in range(tries):
            try:
                out = model(part)
                if len(out) == len(part):
                    return out
            except Exception:
                pass
            time.sleep(wait * 2**k if wait else 0)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or load()
            records, out = frame.to_dict("records"), []
            for at in range(0, len(records), batch):
                part = records[at : at + batch]
                got = attempt(model, part)
                out += got if got is not None else [x[0] if (x := attempt(model, [r])) else None for r in part]
            yield pd.DataFrame({key: frame[key], "prediction": [x or "" for x in out], "status": ["failed" if x is None else "ok" for x in out]})

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, prediction string, status string")


#: What reading a page gives.
PAGE_LINES = "array<struct<bbox:array<int>,text:string,confidence:double>>"


def read_pages(images: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[tuple]]]], batch: int = 8) -> DataFrame:
    """path, status and lines of each page image (path, content).

    ``load`` makes the reader once a task; it maps images to lists of (bbox, text, confidence).  A batch that fails is
    read image by image, and an image that fails has status ``failed`` and no lines: one bad page costs no other.
    """

    def lines(found):
        return [{"bbox": [int(x) for x in box], "text": str(t), "confidence": float(c)} for box, t, c in found]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or load()
            out = []
            for at in range(0, len(frame), batch):
                part = list(frame["content"].iloc[at : at + batch])
                try:
                    got = [lines(x) for x in model(part)]
                    if len(got) != len(part):
                        raise ValueError("another number of pages")
                except Exception:
                    got = []
                    for image in part:
                        try:
                            got.append(lines(model([image])[0]))
                        except Exception:
                            got.append(None)
                out += got
            yield pd.DataFrame({"path": frame["path"], "status": ["failed" if x is None else "ok" for x in out], "lines": [x or [] for x in out]})

    return images.select("path", "content").mapInPandas(run, f"path string, status string, lines {PAGE_LINES}")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
