"""Batches stay bounded and lose nothing."""

from __future__ import annotations

import pyarrow as pa

from tallyhouse.llm.tasks import bounded, free_name


def test_bounded():
    rows = [None, "", "a" * 10, "b" * 300, "c", "d" * 40, "é" * 30, None]
    batch = pa.RecordBatch.from_pydict({"text": rows, "n": list(range(len(rows)))})
    for limit in (1, 50, 100, 10_000):
        parts = list(bounded([batch.slice(0, 0), batch], "text", limit))
        assert [r for part in parts for r in part.column("n").to_pylist()] == list(range(len(rows)))
        assert all(part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column("text").to_pylist()) <= limit for part in parts)


def test_free_name(spark):
    frame = spark.createDataFrame([(1, 2)], "Own int, own_ int")
    assert free_name(frame, "own") == "own__" and free_name(frame, "other") == "other"
