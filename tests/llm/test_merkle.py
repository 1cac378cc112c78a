"""Operator 12 beside a tree built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCS, awkward
from tallyhouse.llm import merkle, queries
from tallyhouse.sources.store import Store


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text) -> str:
    return h(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def siblings_to_root(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of a list of nodes, and each one's siblings (before, after) on the way up."""
    ways, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(start, min(start + 16, len(nodes))) for start in range(0, len(nodes), 16)]
        for run in runs:
            for at in run:
                for leaf in owners[at]:
                    ways[leaf].append(("".join(nodes[i] for i in run if i < at), "".join(nodes[i] for i in run if i > at)))
        nodes, owners = [h(*(nodes[i] for i in run)) for run in runs], [sum((owners[i] for i in run), []) for run in runs]
    return nodes[0], ways


def plain(rows: list) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof, folded root, verified of each row."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source: dict = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append((row["doc_id"], leaf_of(row, row["text"]), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    first = lambda leaf: (leaf[0] is not None, leaf[0] or 0, leaf[1])
    leaves = {source: sorted(by_source[source], key=first) for source in order}
    trees = {source: siblings_to_root([leaf for _, leaf, _ in leaves[source]]) for source in order}
    root, over = siblings_to_root([trees[source][0] for source in order])
    out = []
    for place, source in enumerate(order):
        subroot, ways = trees[source]
        for (doc_id, leaf, row), way in zip(leaves[source], ways):
            way = way + over[place]
            value = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                value = leaf_of(row, None if row["text"] is None else row["text"].translate(lower))
            for before, after in way:
                value = h(before, value, after)
            out.append((doc_id, leaf, subroot, root, h(*(b + a for b, a in way)), value, value == root))
    return sorted(out, key=str)


def check(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == plain([r.asDict() for r in docs.collect()])


def test_awkward_rows(spark, tmp_path):
    check(spark, spark.createDataFrame(awkward(), DOCS), tmp_path)


def test_test_table(spark, small, tmp_path):
    check(spark, queries.table(spark, small, "documents"), tmp_path)


@pytest.mark.parametrize("sizes", [[1], [16, 17], [1, 256, 257], [5000, 1, 300]])
def test_sizes_around_full_trees(spark, tmp_path, sizes):
    """Sources that end just at, before and behind a full run; ids in no order."""
    parts = [
        spark.range(n).select(
            ((F.col("id") * 7919) % 100_003).alias("doc_id"),
            F.lit(f"s{at}").alias("source"),
            F.lit("en").alias("lang"),
            F.col("id").alias("n_chars"),
            F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"),
        )
        for at, n in enumerate(sizes)
    ]
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.union(part)
    check(spark, docs, tmp_path)


def test_many_sources(spark, tmp_path):
    """More sources than a subtree holds, most of one row, among them the null source."""
    docs = spark.range(700).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('Host ', id) END AS source",
        "CAST(NULL AS string) AS lang",
        "id AS n_chars",
        "'Same' AS text",
    )
    check(spark, docs, tmp_path)


def test_empty_table_has_no_root(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_merkle(spark, str(tmp_path)).collect() == []
    assert merkle.write_manifest(docs, Store.fresh(spark, "none")).root is None


def test_only_some_levels_are_stored(spark):
    """Of 5,000 leaves under a tree of four levels, levels 0, 2 and 4 are stored."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "'a' AS source", "'b' AS lang", "1L AS n_chars", "'c' AS text")
    manifest = merkle.write_manifest(docs, Store.fresh(spark, "levels"))
    assert [level.count() for level in manifest.sources] == [5000, 20, 1]
    longest = manifest.proofs().select(F.max(F.size("way"))).first()[0]
    assert longest == 4
