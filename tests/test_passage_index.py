"""The kept index: ranks of an index built anew, few pairs scored, nothing shuffled that is bucketed."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.text import search_tokens
from tallyhouse.operators import bm25, passage_index
from tallyhouse.operators.passage_index import PassageIndex
from tallyhouse.sources.store import Store
from tallyhouse.sources.versions import Conflict

CHUNKS = "chunk_id long, heading string, text string"
WORDS = "amber birch cedar delta ember flint grove heath inlet jetty knoll ledge marsh north ocean ridge shore track umber vale".split()


def prose(at: int, n: int) -> str:
    return " ".join(WORDS[(at * 5 + i * i * (at % 3 + 1) + i) % len(WORDS)] + ("" if (at + i) % 4 else str(at % 23)) for i in range(n))


def chunk_rows(start: int, stop: int) -> list[tuple]:
    rows = [(i, f"Section {i % 5}" if i % 7 else None, prose(i % 400, 5 + i % 60)) for i in range(start, stop)]
    return [(i, h, None if i % 97 == 0 else "" if i % 89 == 0 else t) for i, h, t in rows]


QUERIES = [
    (1, "amber1 birch"),
    (2, "common section shore ridge ridge ridge"),  # repeats count again; a hot term
    (3, "nothing of this is there zzz"),
    (4, ""),
    (5, None),
    (6, " ".join(WORDS)),
    (7, "vale22 track7 umber3 section"),
    (8, prose(17, 30)),
]


def plain(chunks: list[tuple], tokens: dict, queries: dict, k: int) -> dict:
    """Every chunk scored for every query, ties by id."""
    n, out = len(chunks), {}
    avgdl = sum(len(tokens[c[0]]) for c in chunks) / n
    df: dict = {}
    for c in chunks:
        for term in set(tokens[c[0]]):
            df[term] = df.get(term, 0) + 1
    for query, asked in queries.items():
        scores = []
        for c in chunks:
            own = tokens[c[0]]
            score = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * len(own) / avgdl))
                for t in asked
                if t in own
            )
            if score > 0:
                scores.append((-round(score, 6), c[0]))
        out[query] = [(rank, chunk, -score) for rank, (score, chunk) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def token_lists(spark, frame, key, text) -> dict:
    return {r[0]: r[1] or [] for r in frame.select(key, search_tokens(text)).collect()}


def ranks(found) -> dict:
    out: dict = {}
    for r in sorted(found.best.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.chunk_id, round(r.score, 6)))
    return out


def expected(spark, rows, asked, k):
    frame = spark.createDataFrame(rows, CHUNKS)
    tokens = token_lists(spark, frame, "chunk_id", bm25.index_text())
    queries = token_lists(spark, asked, "query_id", F.col("query"))
    return {q: best for q, best in plain(rows, tokens, queries, k).items() if best}


def folder(spark) -> str:
    return Store.fresh(spark, "index").folder


@pytest.mark.parametrize("k", [1, 3, 20])
def test_beside_scoring_everything(spark, asked, k):
    rows = chunk_rows(0, 900)
    index = PassageIndex.open(spark, folder(spark)).add(spark.createDataFrame(rows, CHUNKS))
    assert ranks(index.search(asked, k)) == expected(spark, rows, asked, k)


def test_appends_and_deletions_give_the_ranks_of_a_rebuild(spark, asked):
    place = folder(spark)
    index = PassageIndex.open(spark, place).add(spark.createDataFrame(chunk_rows(0, 600), CHUNKS))
    index = index.add(spark.createDataFrame(chunk_rows(600, 660), CHUNKS))
    assert ranks(index.search(asked)) == expected(spark, chunk_rows(0, 660), asked, 3)
    gone = {*range(0, 660, 3), 100_000}
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
    left = [row for row in chunk_rows(0, 660) if row[0] not in gone]
    assert (index.chunks, ranks(index.search(asked))) == (len(left), expected(spark, left, asked, 3))
    index = index.add(spark.createDataFrame(chunk_rows(0, 1) + chunk_rows(3, 4), CHUNKS))  # ids that were deleted come back
    left += chunk_rows(0, 1) + chunk_rows(3, 4)
    assert ranks(index.search(asked)) == expected(spark, left, asked, 3)
    merged = PassageIndex.open(spark, place).merge()
    assert len(merged.segments) == 1 and not merged.segments[0]["deleted"]
    assert ranks(merged.search(asked)) == expected(spark, left, asked, 3)
    assert merged.term_stats().count() == len({t for ts in token_lists(spark, spark.createDataFrame(left, CHUNKS), "chunk_id", bm25.index_text()).values() for t in ts})


def test_statistics_are_those_of_the_text(spark):
    chunks = spark.createDataFrame(chunk_rows(0, 200), CHUNKS)
    index = PassageIndex.open(spark, folder(spark)).add(chunks.where("chunk_id < 150")).add(chunks.where("chunk_id >= 150"))
    rows = lambda frame: sorted((r.term, r.df, round(r.idf, 9), round(r.avgdl, 9)) for r in frame.collect())
    assert rows(index.term_stats()) == rows(bm25.term_stats(chunks))


def test_search_reads_no_text_and_moves_no_postings(spark, asked):
    """The postings' side of the join has no exchange, also where nothing may be broadcast."""
    chunks = spark.createDataFrame(chunk_rows(0, 300), CHUNKS)
    index = PassageIndex.open(spark, folder(spark)).add(chunks)
    terms = bm25.query_terms(asked).select("query_id", "term", F.lit(1.0).alias("w"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._asked(terms)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line and "hits" in line)
    assert "Bucketed: true" in scan
    depth = lambda line: len(re.match(r"[ :|+\-*()\d]*", line)[0])
    lines = plan.split("\n")
    at = lines.index(scan)
    above, level = [], depth(scan)
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    names = [re.sub(r"^[ :|+\-*()\d]*", "", line).split(" ")[0] for line in above]
    assert "SortMergeJoin" in names and "Exchange" not in names[: names.index("SortMergeJoin")]


def test_few_pairs_are_scored(spark):
    """Where some terms are in every chunk and others are rare, most pairs are never scored in full."""
    rows = [(i, "report", f"common word{i % 2000} {prose(i, 20)} {'rare' + str(i % 300) if i % 3 == 0 else ''}") for i in range(3000)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(i, f"report common rare{i} word{i} shore ridge") for i in range(0, 60, 3)], "query_id long, query string")
    found = PassageIndex.open(spark, folder(spark)).add(chunks).search(asked)
    whole = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in bm25.search(chunks, asked).collect()}
    assert {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in found.best.collect()} == whole
    assert found.scored.count() * 10 <= 20 * 3000


def test_an_index_without_chunks(spark, asked):
    none = spark.createDataFrame([], CHUNKS)
    index = PassageIndex.open(spark, folder(spark))
    assert index.search(asked).best.collect() == [] and index.term_stats().collect() == []
    assert index.add(none).chunks == 0
    assert index.delete(none.select("chunk_id")).merge().segments == []


def test_two_writers(spark, asked):
    """Both segments stay; a writer that lost tries again on top of the other one."""
    place = folder(spark)
    one, two = PassageIndex.open(spark, place), PassageIndex.open(spark, place)
    one.add(spark.createDataFrame(chunk_rows(0, 50), CHUNKS))
    index = two.add(spark.createDataFrame(chunk_rows(50, 90), CHUNKS))
    assert (index.version.number, index.chunks) == (2, 90)
    with pytest.raises(Conflict):
        index.versions.commit(one.version, {})
    assert ranks(PassageIndex.open(spark, place).search(asked)) == expected(spark, chunk_rows(0, 90), asked, 3)


def test_a_larger_segment_has_more_buckets_and_salts(spark, asked, monkeypatch):
    """No bucket, which one task sorts, grows with the segment."""
    monkeypatch.setattr(passage_index, "BUCKET_POSTINGS", 300)
    monkeypatch.setattr(passage_index, "SALT_CHUNKS", 30)
    rows = chunk_rows(0, 360)
    chunks = spark.createDataFrame(rows, CHUNKS)
    index = PassageIndex.open(spark, folder(spark)).add(chunks)
    postings, segment = bm25.postings(chunks).count(), index.segments[0]
    assert (segment["buckets"], segment["salts"]) == (math.ceil(postings / 300), 12) and segment["buckets"] > 8
    sizes = [r.n for r in index._postings(segment).groupBy(F.input_file_name()).agg(F.sum(F.size("hits")).alias("n")).collect()]
    assert sum(sizes) == postings and max(sizes) < postings / 4
    assert ranks(index.search(asked)) == expected(spark, rows, asked, 3)
