"""Operator 13 beside a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import DOCS, awkward
from tallyhouse.llm import queries, spelling
from tallyhouse.sources.store import Store

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % 199 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    """Near words by deleting a letter from both, then compared; no trees."""
    by_shape: dict[str, set] = {}
    for word in words:
        for shape in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
            by_shape.setdefault(shape, set()).add(word)
    near: dict[str, set] = {word: set() for word in words}
    for some in by_shape.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        form[word] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        out[word] = (form[word], root, n, len(near[word]), words.get(form[word]))
    return out


def found(frame) -> dict[str, tuple]:
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def variants_of(spark, words: dict[str, int]):
    return found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), Store.fresh(spark, "spelling")))


def test_test_tables(spark, small):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    expected = plain_variants(plain_words(rows))
    assert found(queries.op13_spelling(spark, small)) == expected
    assert any(form for form, *_ in expected.values())


def test_vocabulary_of_awkward_rows(spark):
    docs = spark.createDataFrame(awkward() * 3, DOCS)
    words = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert words == plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.vocabulary(docs.limit(0)).collect() == []


def made_up(seed: int, size: int) -> dict[str, int]:
    """Words with all kinds of near ones: few letters, accents, anagrams, letters that occur often, long chains of forms."""
    draw = random.Random(seed)
    words = {}
    while len(words) < size:
        word = "".join(draw.choice("abcéÿ×Àz") for _ in range(draw.randint(6, 8)))
        words[word] = draw.choice((5, 6, 30, 200, 5000))
        at = draw.randrange(len(word))
        for other in (word[:at] + word[at + 1 :], word[:at] + "q" + word[at:], word[:at] + "x" + word[at + 1 :], word[::-1]):
            if len(other) >= 6:
                words.setdefault(other, draw.choice((5, 7, 1000)))
    words |= {"a" * n: 5**n // 1000 + 5 for n in range(6, 30)} | {"ab" * 3000: 5, "ab" * 3000 + "b": 25}
    return words


@pytest.mark.parametrize("cell, leaf, sample", [(4096, 48, 200_000), (40, 4, 200_000), (60, 8, 300)])
def test_made_up_words(spark, monkeypatch, cell, leaf, sample):
    """Also where cells are small, and where the sample knows few of the words and not all lengths."""
    for name, value in (("CELL", cell), ("LEAF", leaf), ("SAMPLE", sample)):
        monkeypatch.setattr(spelling, name, value)
    words = made_up(7, 2500)
    assert variants_of(spark, words) == plain_variants(words)


def test_few_or_no_words(spark):
    assert variants_of(spark, {"lonely": 9}) == {"lonely": (None, "lonely", 9, 0, None)}
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty, Store.fresh(spark, "spelling")).collect() == []
    assert variants_of(spark, {"abcdef": 5, "abcdeg": 25, "abcdeh": 25}) == {
        "abcdef": ("abcdeg", "abcdeg", 5, 2, 25),
        "abcdeg": (None, "abcdeg", 25, 2, None),
        "abcdeh": (None, "abcdeh", 25, 2, None),
    }


def test_boxes_leave_out_most_words():
    """A search compares its word with a small part of the cell."""
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(4000)]
    cell = spelling.Cell(words, [5] * len(words))
    compared = sum(len(leaf.held) * len(at) for leaf, at in spelling.searched(cell.root, cell.points, 1))
    assert compared < 0.15 * len(words) ** 2
