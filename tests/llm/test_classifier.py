"""Operator 4: held-out accuracy, and what happens without labels."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from llm_fixtures import DOCS, awkward
from tallyhouse.llm import queries, quality_classifier
from tallyhouse.sources.store import Store


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


FOLDER = "/root/testdata/sf0.01"


def trained(spark, docs, labels, **settings):
    return quality_classifier.train(docs, labels, Store.fresh(spark, "classifier"), **settings)


def test_held_out_accuracy(spark):
    """Labels of one half of the documents teach; those of the other half are the test."""
    labels = queries.table(spark, FOLDER, "labels")
    documents = queries.table(spark, FOLDER, "documents")
    model = trained(spark, documents, labels.where("doc_id % 2 = 0"))
    rows = quality_classifier.score(documents, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 100 and len(bad) > 10
    assert np.mean(good) >= 0.97
    assert np.mean(bad) <= 0.1


def in_memory(views, labels, pool, chance, rounds):
    """Co-training with everything in arrays, sorted where the operator counts margins: the plain version."""
    held = np.arange(len(labels)) % 4 == 3
    y, truth = labels[~held].astype(float), labels[held] == 1
    x = [view[~held] for view in views]
    fitted = [quality_classifier.Logistic.fit(a, y) for a in x]
    marks = [np.full(len(chance), -1) for _ in views]
    for _ in range(rounds):
        new = [m.copy() for m in marks]
        for one, other in ((0, 1), (1, 0)):
            own, margin = fitted[one].margin(views[one][held]), fitted[one].margin(pool[one])
            pairs = [(a > b) + (a == b) / 2 for a in own[truth] for b in own[~truth]]
            n = truth.sum(), (~truth).sum()
            if np.mean(pairs) - 0.5 < 2.33 * np.sqrt((n[0] + n[1] + 1) / (12 * n[0] * n[1])):
                continue
            free = marks[other] < 0
            for mark, share, sign in ((1, y.mean(), 1), (0, 1 - y.mean(), -1)):
                sure = None  # the lowest margin above which 95 % of the rows held back are right
                for margin_held in sorted(sign * own):
                    above = sign * own >= margin_held
                    if (truth[above] == mark).mean() >= 0.95:
                        sure = max(np.log(0.95 / 0.05), margin_held)
                        break
                if sure is None:
                    continue
                steps, left = np.floor(sign * margin * 50), len(chance) * 0.05 * share
                for step in sorted(set(steps[free].tolist()), reverse=True):
                    some = free & (steps == step)
                    if step < (np.floor(sure * 50) if sure > np.log(0.95 / 0.05) else np.ceil(sure * 50)) or not left:
                        break
                    if some.sum() > left:
                        some &= chance < left / some.sum()
                        left = 0
                    else:
                        left -= some.sum()
                    new[other][some] = mark
        marks = new
        if any((m >= 0).any() for m in marks):
            for view in range(2):
                got = marks[view] >= 0
                weight = min(1.0, len(y) / max(1, got.sum()))
                model = quality_classifier.Logistic(fitted[view].centre, fitted[view].scale, fitted[view].weights.copy())
                for _ in range(20):
                    more = model.sums(pool[view][got], marks[view][got].astype(float))
                    if model.step(model.sums(x[view], y) + weight * more) < 1e-9:
                        break
                fitted[view] = model
    return fitted, [int((m >= 0).sum()) for m in marks]


def test_beside_a_version_in_memory(spark):
    """500 documents, two hundred of them labelled: the same rows are handed over and the same weights learned."""
    documents = queries.table(spark, FOLDER, "documents").where("doc_id < 500")
    labels = queries.table(spark, FOLDER, "labels").orderBy("doc_id").limit(200)
    store = Store.fresh(spark, "classifier")
    model = quality_classifier.train(documents, labels, store)
    rows = store.read("features").collect()
    width = quality_classifier.WIDTHS
    number = lambda some: tuple(
        np.array([np.frombuffer(r[name], np.float32) for r in some], float).reshape(-1, w) for name, w in zip(("content", "metadata"), width)
    )
    known = sorted((r for r in rows if r.quality is not None), key=lambda r: (zlib.crc32(r.id.encode()), r.id))
    free = [r for r in rows if r.quality is None]
    fitted, handed = in_memory(number(known), np.array([r.quality for r in known]), number(free), np.array([r.chance for r in free]), 3)
    assert [sum(part) for part in zip(*model.handed)] == handed and sum(handed) > 20
    for ours, plain in zip(model.views, fitted):
        assert np.allclose(ours.weights, plain.weights, atol=1e-5)


def test_rows_handed_over_grow_with_the_table(spark):
    """No bound on rows without a label: twice the documents, about twice the rows handed over."""
    documents, labels = (queries.table(spark, FOLDER, name) for name in ("documents", "labels"))
    some = labels.where("doc_id < 500")
    fewer = sum(map(sum, trained(spark, documents.where("doc_id < 500 OR doc_id % 2 = 0"), some).handed))
    more = sum(map(sum, trained(spark, documents, some).handed))
    free = [documents.where(f).join(some, "doc_id", "left_anti").count() for f in ("doc_id < 500 OR doc_id % 2 = 0", "true")]
    assert fewer > 20 and 0.8 * free[1] / free[0] <= more / fewer <= 1.25 * free[1] / free[0]


def test_rounds_help(spark):
    """The error on documents whose labels were not shown falls by co-training."""
    documents, labels = (queries.table(spark, FOLDER, name) for name in ("documents", "labels"))
    rest = labels.where("doc_id % 2 = 1")

    def error(rounds):
        model = trained(spark, documents, labels.where("doc_id % 2 = 0"), rounds=rounds)
        assert sum(map(sum, model.handed)) > 20 or not rounds
        scored = quality_classifier.score(documents, model).join(rest, "doc_id").collect()
        return np.mean([(r.score - r.quality) ** 2 for r in scored])

    assert error(3) < error(0)


def test_views_teach_each_other():
    """Two informative views, few labels, everything in arrays."""
    draw = np.random.default_rng(0)

    def rows(n):
        y = draw.integers(0, 2, n)
        return y, (y[:, None] * 3 + draw.normal(size=(n, 2)), y[:, None] * 3 + draw.normal(size=(n, 3)))

    y, views = rows(40)
    _, pool = rows(2000)
    chance, done = draw.random(2000), []

    def hand_over(rounds):
        done[:] = rounds
        before, after = (quality_classifier.labels_so_far(some, pool, chance) for some in (rounds[:-1], rounds))
        return tuple(int(((b < 0) & (a >= 0)).sum()) for b, a in zip(before, after))

    def sums(models):
        given = quality_classifier.labels_so_far(done, pool, chance)
        return [m.sums(v[g >= 0], g[g >= 0]) for m, v, g in zip(models, pool, given)]

    model = quality_classifier.co_train(views, y, 2000, lambda d, m: quality_classifier.counted(d, m, pool, chance), hand_over, sums)
    assert sum(map(sum, model.handed)) > 100
    truth, test = rows(1000)
    assert ((model.scores(*test)[0] > 0.5) == truth).mean() > 0.97


def test_a_view_that_knows_nothing_hands_over_nothing():
    draw = np.random.default_rng(1)
    good = draw.random(400) < 0.85
    assert quality_classifier.sure_from(draw.normal(size=400) + 5, good) == (quality_classifier.NEVER,) * 2
    sure = quality_classifier.sure_from(np.where(good, 8.0, -8.0) + draw.normal(size=400), good)
    assert all(147 <= floor < quality_classifier.NEVER for floor in sure)


def test_shares_of_the_last_step():
    counts = np.zeros(2 * quality_classifier.MOST * quality_classifier.STEPS + 1)
    zero = quality_classifier.MOST * quality_classifier.STEPS
    counts[zero + 400], counts[zero + 300] = 10, 40
    assert quality_classifier.cut_of(counts, 10, 148) == (301, 0.0)
    assert quality_classifier.cut_of(counts, 20, 148) == (301, 0.25)
    least, share = quality_classifier.cut_of(counts, 1000, 148)
    assert share == 0.0 and least == 148  # 0.95 in fiftieths of a margin


def test_without_labels_everything_stays(spark, docs):
    for some in ([], [(1, 1), (2, 1)], [(3, None), (None, 0)], [(3, 0), (3, 1)]):
        labels = spark.createDataFrame(some, "doc_id long, quality int")
        model = trained(spark, docs, labels)
        rows = quality_classifier.score(docs, model).collect()
        assert len(rows) == len(awkward()) and all(r.kept and r.score == 0.5 for r in rows)


def test_filter_keeps_columns(spark, docs):
    folder = "/root/testdata/sf0.001"
    documents = queries.table(spark, folder, "documents")
    model = trained(spark, documents, queries.table(spark, folder, "labels"))
    kept = quality_classifier.good_documents(docs, model)
    assert kept.schema == docs.schema
    scored = quality_classifier.score(docs, model).where("kept")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored.collect())
    bare = docs.select("doc_id", "text")
    assert quality_classifier.score(bare, model).count() == len(awkward())
    assert quality_classifier.good_documents(docs.limit(0), model).collect() == []


def test_op4_query(spark, small):
    rows = queries.op4_quality_classifier(spark, small).collect()
    assert len(rows) == queries.table(spark, small, "documents").count()
    again = {r.doc_id: r.score for r in queries.op4_quality_classifier(spark, small).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
