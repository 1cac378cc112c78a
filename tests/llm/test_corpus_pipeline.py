"""The pipeline against the plain versions of its stages."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm_fixtures import DOCS, awkward
from tallyhouse.llm import queries, quality_classifier, secret_scan
from tallyhouse.sources.store import Store
from test_mixing import plain_plan
from test_near_copies import classes, plain_print


def plain_run(rows: list[dict], model) -> Counter:
    """What is left after the classifier's stage is worked off in plain Python."""
    prints = [plain_print(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    least: dict = {}
    for r, g in zip(rows, classes(len(rows), links)):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    rows = [dict(r, text=secret_scan.masked(r["text"], "<SECRET>")) for r in rows if r["doc_id"] in set(least.values())]
    taken = {p[0]: p[4] for p in plain_plan([(r["doc_id"], r["text"], r["source"]) for r in rows])}
    library = Tokenizer.from_file(queries.VOCABULARY)
    out: Counter = Counter()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out[r["doc_id"], len(ids), digest, hashlib.sha256(r["text"].encode()).hexdigest()] += taken[r["doc_id"]]
    return +out


def test_run(spark, small):
    documents = queries.table(spark, small, "documents")
    model = quality_classifier.train(documents, queries.table(spark, small, "labels"), Store.fresh(spark, "test"))
    good = [r.asDict() for r in quality_classifier.good_documents(documents, model).collect()]
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == plain_run(good, model)


def test_stages_keep_the_columns(spark, small):
    docs = spark.createDataFrame(awkward(), DOCS)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "secret scans", "mixing sources", "bpe encoding and decoding"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("at", range(5))
def test_stages_take_an_empty_table(spark, small, at):
    empty = spark.createDataFrame([], DOCS)
    assert corpus_pipeline.STAGES[at][1](spark, empty, small).collect() == []
