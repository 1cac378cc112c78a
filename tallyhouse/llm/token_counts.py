"""Token counts (1) that follow edits without counting a text again.

Each document keeps a segment tree: a leaf for each run of characters up to a space between visible characters, where
a pre-token always starts; inner nodes add up characters and tokens. An edit descends by character position,
encodes anew the leaves it touches and one leaf of context to either side, cuts that stretch into leaves again, and
updates the sums above. Where more leaves come out than there is room for, the leaves of the smallest stretch of the tree
that has room are spread over it, so leaves stay small however many edits meet in one place.

Defined results: a null text counts as empty; positions are code points and are cut to the text; edits apply in
their given order, each to the text that the ones before left; null edits, and edits whose start, end or
replacement is null, change nothing. Repeated rows are each answered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.byte_pairs import load
from tallyhouse.llm.tasks import bounded, ship, texts

#: White space and the visible characters behind it; goes on over white space that starts otherwise than with a space.
LEAF = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*|\s+")

EDITS = "array<struct<start:long,stop:long,text:string>>"


def cut(text: str) -> list[str]:
    """The leaves of a text. White space at the end belongs to the last leaf."""
    leaves = LEAF.findall(text)
    if len(leaves) > 1 and leaves[-1].isspace():
        leaves[-2:] = [leaves[-2] + leaves[-1]]
    return leaves


class TokenTree:
    """Character and token sums over the leaves of one text."""

    def __init__(self, leaves: list[str], counts: list[int], count: Callable[[list[str]], list[int]]):
        self.count, self.encoded = count, 0
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = leaves + [""] * (self.size - len(leaves))
        self.chars, self.tokens = (self._sums(values) for values in (list(map(len, leaves)), counts))

    def _sums(self, values: list[int]) -> np.ndarray:
        tree = np.zeros(2 * self.size, np.int64)
        tree[self.size : self.size + len(values)] = values
        level = self.size
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
            level //= 2
        return tree

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts; the last one with text for the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            held = int(self.chars[node])
            if position >= start + held and self.chars[node + 1]:
                start += held
                node += 1
        return node - self.size, start

    def _lay(self, low: int, high: int, leaves: list[str], tokens: list[int]) -> None:
        """Spread leaves over the places from ``low`` to ``high`` (exclusive) and add up what lies above."""
        room = high - low
        self.leaves[low:high] = [""] * room
        at = [low + i * room // max(1, len(leaves)) for i in range(len(leaves))]
        for place, leaf in zip(at, leaves):
            self.leaves[place] = leaf
        for tree, values in ((self.chars, list(map(len, leaves))), (self.tokens, tokens)):
            tree[self.size + low : self.size + high] = 0
            tree[[self.size + place for place in at]] = values
            left, right = self.size + low, self.size + high - 1
            while left > 1:
                left, right = left // 2, right // 2
                tree[left : right + 1] = tree[2 * left : 2 * right + 2 : 2] + tree[2 * left + 1 : 2 * right + 2 : 2]

    def _replace(self, first: int, last: int, leaves: list[str], tokens: list[int]) -> None:
        """Put leaves in the place of those from ``first`` to ``last``, which may need a wider stretch."""
        low, high, width = first, last + 1, 1
        while len(leaves) > high - low or (width > 1 and 4 * len(leaves) > 3 * (high - low)):
            width *= 2
            if width > self.size:
                self.leaves += [""] * self.size
                held = [self.tokens[self.size :].tolist(), self.chars[self.size :].tolist()]
                self.size *= 2
                self.tokens, self.chars = (self._sums(values) for values in held)
            wide = first // width * width
            if wide + width <= last:
                continue
            near = [at for at in (*range(wide, low), *range(high, wide + width)) if self.leaves[at]]
            before = [at for at in near if at < low]
            behind = near[len(before) :]
            leaves = [self.leaves[at] for at in before] + leaves + [self.leaves[at] for at in behind]
            tokens = [int(self.tokens[self.size + at]) for at in before] + tokens + [int(self.tokens[self.size + at]) for at in behind]
            low, high = wide, wide + width
        self._lay(low, high, leaves, tokens)

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf with text, or the given one at the end."""
        at = leaf + step
        while 0 <= at < len(self.leaves) and not self.leaves[at]:
            at += step
        return at if 0 <= at < len(self.leaves) else leaf

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace the characters from ``start`` to ``stop`` (exclusive)."""
        length = int(self.chars[1])
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        first, _ = self._leaf_at(start)
        last, _ = self._leaf_at(max(start, stop - 1))
        first, last = self._beside(first, -1), self._beside(last, 1)
        begin = self._begin(first)
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - begin] + text + old[stop - begin :]
        leaves = cut(new)
        self._replace(first, last, leaves, list(self.count(leaves)) if leaves else [])
        self.encoded += len(new)

    def _begin(self, leaf: int) -> int:
        """How many characters stand before a leaf."""
        node, total = self.size + leaf, 0
        while node > 1:
            if node & 1:
                total += int(self.chars[node - 1])
            node //= 2
        return total


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with a column ``edits`` from a table of (doc_id, seq, start, stop, text); by a join on ``doc_id``."""
    lists = edits.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text"))).alias("edits")
    )
    lists = lists.withColumn("edits", F.transform("edits", lambda e: e.dropFields("seq")).cast(EDITS))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left")


def token_counts(
    docs: DataFrame, vocabulary: str, find: Callable[[str], list[tuple[int, int, str]]] | None = None
) -> DataFrame:
    """Counts before and after edits: those in the column ``edits``, or those that ``find`` names for a text.

    ``n_tokens`` and ``n_tokens_edited`` count the text and the edited text, ``n_edits`` the edits,
    ``encoded_chars`` the characters that edits encoded anew, ``n_chars_edited`` those of the edited text.
    """
    ship(docs.sparkSession)
    given = find is None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(vocabulary)
        for batch in bounded(batches, "text", 2 << 20):
            cuts = [cut(text) for text in texts(batch)]
            counts = pairs.leaf_counts(cuts)
            edits = batch.column("edits").to_pylist() if given else [None] * len(cuts)
            rows = []
            for leaves, tokens, own in zip(cuts, counts, edits):
                tree = TokenTree(leaves, tokens, pairs.counts)
                before = tree.total
                if given:
                    todo = [
                        (e["start"], e["stop"], e["text"])
                        for e in own or []
                        if e and None not in (e["start"], e["stop"], e["text"])
                    ]
                else:
                    todo = find(tree.text())
                for start, stop, text in todo:
                    tree.edit(start, stop, text)
                rows.append((before, len(todo), tree.total, tree.encoded, int(tree.chars[1])))
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    frame = docs.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits")) if given else docs.select("doc_id", "text")
    return frame.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in COUNTS))


COUNTS = ("n_tokens", "n_edits", "n_tokens_edited", "encoded_chars", "n_chars_edited")
