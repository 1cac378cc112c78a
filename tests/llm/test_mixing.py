"""Operator 7 against a plain version."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCS, awkward
from tallyhouse.llm import mixing, queries
from tallyhouse.sources.store import Store

WEIGHTS, RAMPS = (5, 2, 1), (-0.5, 0.0, 0.5)


def plain_targets(sizes: dict) -> dict:
    """Shares by weight, with what is above twice a source's size shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full


def plain_plan(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, source_size, target, times taken) by one running sum for each source."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes: dict = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    target, out = plain_targets(sizes), []
    draw = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    for source in sizes:
        at = 0
        own = [(i, n) for i, s, n in sized if s == source]
        for i, n in sorted(own, key=lambda r: (draw(r[0]), r[0] or 0, r[1])):
            middle = at + n / 2
            out.append((i, n, sizes[source], target[source], sum(middle + turn * sizes[source] < target[source] for turn in (0, 1))))
            at += n
    return out


def check(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = sorted(plain_plan(rows), key=key)
    have = sorted(((r.doc_id, r.size, r.source_size, r.target, len(r.positions)) for r in got), key=key)
    assert [h[:3] + h[4:] for h in have] == [w[:3] + w[4:] for w in want]
    assert all(h[3] == pytest.approx(w[3]) for h, w in zip(have, want))


def test_awkward_rows(spark):
    frame = spark.createDataFrame(awkward(), DOCS)
    got = mixing.plan(frame, Store.fresh(spark, "test")).collect()
    check([(r[0], r[1], r[3]) for r in awkward()], got)
    assert mixing.plan(frame.limit(0), Store.fresh(spark, "test")).collect() == []


def test_small_sources_are_full(spark):
    sizes = {"a": 10, "b": 1000, "c": 3000, "d": 5, "e": 0, None: 700}
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    frame = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = {r.source: r.target for r in mixing.plan(frame, Store.fresh(spark, "test")).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_positions_follow_the_schedule(spark):
    frame = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")
    )
    got = mixing.plan(frame, Store.fresh(spark, "test")).select("source", F.explode("positions").alias("p"))
    early = {r.source: r.share for r in got.groupBy("source").agg(F.avg((F.col("p") < 0.5).cast("int")).alias("share")).collect()}
    for source, ramp in zip(("s0", "s1", "s2"), RAMPS):
        assert early[source] == pytest.approx(0.5 - ramp / 4, abs=0.01)
    assert got.agg(F.min("p") >= 0, F.max("p") <= 1).first() == (True, True)


def test_mixed_rows(spark):
    frame = spark.createDataFrame(awkward(), DOCS).where("doc_id < 200 OR doc_id IS NULL").dropDuplicates(["doc_id"])
    plan = {r.doc_id: len(r.positions) for r in mixing.plan(frame, Store.fresh(spark, "test")).collect()}
    got = mixing.mixed(frame, Store.fresh(spark, "test"))
    assert got.columns == frame.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {doc_id: n for doc_id, n in plan.items() if n}


def test_rows_that_share_an_id_keep_their_own_plan(spark):
    rows = [(None if i % 3 else i % 50, f"text {i} " + "w " * (i % 7), "src%d" % (0 if i % 10 else 1 + i // 10 % 2)) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(frame, Store.fresh(spark, "test"))
    key = lambda r: (r[0] or -1, *r[1:3], r[4])
    have = [(r.doc_id, r.size, r.source_size, r.target, len(r.positions)) for r in plan.collect()]
    assert sorted(map(key, have)) == sorted(map(key, plain_plan(rows)))
    got = [tuple(r) for r in mixing.mixed(frame, Store.fresh(spark, "test")).collect()]
    words: dict = {}
    for _, text, source in got:
        words[source] = words.get(source, 0) + len(text.split())
    for source, target in {(r.source, r.target) for r in plan.collect()}:
        assert abs(words[source] - target) <= 8
    assert set(got) <= set(rows) and max(got.count(r) for r in rows) == 2


def test_op7_query(spark, small):
    docs = [(r.doc_id, r.text, r.source) for r in queries.table(spark, small, "documents").collect()]
    check(docs, mixing.plan(queries.table(spark, small, "documents"), Store.fresh(spark, "test")).collect())
    one, two = (sorted(map(tuple, queries.op7_mixing(spark, small).collect()), key=str) for _ in range(2))
    assert one == two
    sources = {i: s for i, _, s in docs}
    taken: dict = {}
    for doc_id, size, _, target, words, *_ in one:
        assert words in (0, size, 2 * size)
        total, aim = taken.get(sources[doc_id], (0, target))
        taken[sources[doc_id]] = (total + words, aim)
    largest = max(r[1] for r in one)
    assert all(abs(total - aim) <= largest for total, aim in taken.values())
