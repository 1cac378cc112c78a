"""Spelling variants (13): words one edit apart, found by k-d trees over letter counts.

One inserted or deleted letter changes the letter counts by one in L1 distance, one replaced letter by two (one up, one
down). So near words of a pair of lengths lie in small boxes of the space of letter counts, and k-d trees find them: for each
length, a tree over a bounded sample of its words (``SAMPLE``) cuts the space into cells of about ``CELL`` words; each word
is sent to its own cell and, as a search, to the other cells of its own and the next length whose box is near enough. A task
builds a k-d tree over the words of a cell, runs the searches down it, leaving out boxes that are too far, and compares the
letters, in order, of what is left. Every word is indexed and every pair is found; the sample only decides where cells are cut.

Counts are kept up to two for each letter (accented letters share six places) as a thermometer code of 64 bits: a plane
``count >= c`` is a bit, a box is the AND and the OR of its words, distances are bit counts. Capping and sharing can only bring
vectors nearer, so the bound holds, and the letters decide.

Defined results: null text has no words; a null ``doc_id`` counts as empty where the checksum is made; words and forms are ranked by
count, then by code point; an empty table gives no words. Repeated rows count each time. Columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tasks import ship
from tallyhouse.sources.store import Store

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A near word is the form of a word if it occurs so many times as often.
FORM_TIMES = 5
#: Each run whose checksum this divides loses a letter.
DAMAGE = 199

#: Words that the cuts between cells are fitted on, and words that a cell is to hold.
SAMPLE, CELL = 200_000, 4096
#: Words of a leaf of a cell's tree, and searches that go down it side by side.
LEAF, SIDE_BY_SIDE = 48, 4096

_SENT = "cell string, length int, search boolean, word string, n long"
_PAIRS = "a string, a_n long, b string, b_n long"


# --- Vocabulary ---------------------------------------------------------------


def damaged(run: Column, doc_id: Column) -> Column:
    """A run of letters, of which some lose a letter as a fault of typing would have it."""
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (check % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(check % DAMAGE == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` for each word of enough letters that occurs often enough; shorter runs never leave their row."""
    plain = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = F.regexp_extract_all(plain, F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    listed = docs.select("doc_id", F.explode(runs).alias("run")).select(damaged(F.col("run"), F.col("doc_id")).alias("word"))
    counted = listed.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- Letter counts and trees over them ----------------------------------------


def _places() -> np.ndarray:
    """The place of each letter among the 32 that are counted."""
    code = np.arange(0x100)
    return np.where((code >= 97) & (code <= 122), code - 97, 26 + code % 6).astype(np.uint64)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """The thermometer code of letter counts: low half for one or more, high half for two or more."""
    once, twice = np.zeros(len(letters), np.uint64), np.zeros(len(letters), np.uint64)
    bits = np.uint64(1) << _places()
    for column in np.minimum(letters, 0xFF).T:
        bit = bits[column]
        twice |= once & bit
        once |= bit
    return once | twice << np.uint64(32)


class Node:
    """A box of letter counts: the least (AND) and most (OR) of its points, and a cut or what lies in it."""

    __slots__ = ("least", "most", "cut", "below", "above", "held")

    def __init__(self, least, most, cut=None, below=None, above=None, held=None):
        self.least, self.most, self.cut, self.below, self.above, self.held = least, most, cut, below, above, held


def _halving(points: np.ndarray) -> np.uint64 | None:
    """The plane (a bit) that comes nearest to halving the points; none if all are equal."""
    shares = [(abs(2 * int(np.count_nonzero(points & bit)) - len(points)), bit) for bit in np.uint64(1) << np.arange(64, dtype=np.uint64)]
    off, bit = min(shares, key=lambda share: share[0])
    return bit if off < len(points) else None


def tree(points: np.ndarray, most: int) -> Node:
    """A k-d tree whose leaves hold the places of at most ``most`` points, or of points that are all equal."""

    def grown(at: np.ndarray) -> Node:
        own = points[at]
        box = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        cut = _halving(own) if len(at) > most else None
        if cut is None:
            return Node(*box, held=at)
        has = own & cut != 0
        return Node(*box, cut=cut, below=grown(at[~has]), above=grown(at[has]))

    return grown(np.arange(len(points)))


def near_box(points: np.ndarray, node: Node, less: int) -> np.ndarray:
    """Whether a point is at most one count short of the box, and at most ``less`` counts over it."""
    short = np.bitwise_count(node.least & ~points)
    over = np.bitwise_count(points & ~node.most)
    return (short <= 1) & (over <= less)


def searched(node: Node, points: np.ndarray, less: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves and the places of the points that may have a near one there."""
    stack = [(node, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        at = at[near_box(points[at], node, less)]
        if not len(at):
            continue
        if node.held is not None:
            yield node, at
        else:
            stack += [(node.below, at), (node.above, at)]


# --- Cells ----------------------------------------------------------------


class Cells:
    """The cuts of the space of each length: which cell is a word's own, and which may hold near ones."""

    def __init__(self, sample: list[str], words: int):
        share = max(1.0, words / max(1, len(sample)))
        by_length = {length: list(some) for length, some in groupby(sorted(sample, key=len), len)}
        self.trees = {length: _spaces(tree(counts_of(letters_of(some)), max(1, int(CELL / share)))) for length, some in by_length.items()}

    def own(self, length: int, points: np.ndarray) -> np.ndarray:
        """The number of each point's own cell."""
        out = np.zeros(len(points), np.int64)
        stack = [(self.trees.get(length), np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if node is None or not len(at):
                continue
            if node.held is not None:
                out[at] = node.held
            else:
                has = points[at] & node.cut != 0
                stack += [(node.below, at[~has]), (node.above, at[has])]
        return out

    def near(self, length: int, points: np.ndarray, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Cells of a length, with the places of points that may have near words there."""
        root = self.trees.get(length)
        if root is None:  # words of a length that the sample has none of are one cell
            yield 0, np.arange(len(points))
        else:
            for leaf, at in searched(root, points, less):
                yield leaf.held, at


def _spaces(root: Node) -> Node:
    """The tree with the boxes that its planes bound, not those of the sample, and leaves numbered."""
    leaves = 0

    def widened(node: Node, least, most) -> Node:
        nonlocal leaves
        if node.held is not None:
            leaves += 1
            return Node(least, most, held=leaves - 1)
        # Two of a letter are one of it as well: the plane says something about both bits.
        low_half, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
        below = most & ~(node.cut | (node.cut & low_half) << shift)
        above = least | node.cut | node.cut >> shift
        return Node(least, most, node.cut, widened(node.below, least, below), widened(node.above, above, most))

    return widened(root, np.uint64(0), ~np.uint64(0))


# --- Pairs ----------------------------------------------------------------


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows where the longer word is the shorter one with a letter put in."""
    width = short.shape[1]
    front = np.logical_and.accumulate(short == long[:, :width], axis=1).sum(1)
    back = np.logical_and.accumulate(short[:, ::-1] == long[:, :0:-1], axis=1).sum(1)
    return front + back >= width


class Cell:
    """The words of a cell under a k-d tree of their own."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts, self.letters = words, counts, letters_of(words)
        self.points = counts_of(self.letters)
        self.root = tree(self.points, LEAF)

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of searches and of words of the cell that are one edit apart."""
        points, longer = counts_of(letters), letters.shape[1] < self.letters.shape[1]
        less, found = (0 if longer else 1), [(np.zeros(0, np.int64),) * 2]
        for leaf, at in searched(self.root, points, less):
            own, other = self.points[leaf.held], points[at][:, None]
            close = (np.bitwise_count(own & ~other) <= 1) & (np.bitwise_count(other & ~own) <= less)
            i, j = np.nonzero(close)
            i, j = at[i], leaf.held[j]
            for start in range(0, len(i), 1 << 16):  # bounds what is compared at once
                p, q = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
                right = (one_inserted if longer else one_replaced)(letters[p], self.letters[q])
                found.append((p[right], q[right]))
        return tuple(np.concatenate(part) for part in zip(*found))


def _sent(cells: Cells):
    """Rows for the cells: each word to its own, and as a search to others of its length and of the next one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()), key=lambda row: len(row[0]))
            for length, some in groupby(rows, key=lambda row: len(row[0])):
                words, counts = (np.array(part, dtype=object) for part in zip(*some))
                points = counts_of(letters_of(words.tolist()))
                own = cells.own(length, points)
                sent = [(length, own, np.arange(len(words)), False)]
                for cell, at in cells.near(length, points, 1):
                    at = at[own[at] < cell]  # the pair is found in the cell of the higher number
                    sent.append((length, np.full(len(at), cell), at, True))
                for cell, at in cells.near(length + 1, points, 0):
                    sent.append((length + 1, np.full(len(at), cell), at, True))
                for size, cell, at, search in sent:
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([f"{size}.{c}" for c in cell.tolist()]),
                                pa.array([size] * len(at), pa.int32()),
                                pa.array([search] * len(at)),
                                pa.array(words[at].tolist(), pa.string()),
                                pa.array(counts[at].tolist(), pa.int64()),
                            ],
                            ["cell", "length", "search", "word", "n"],
                        )

    return run


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words; the words of a cell come before the searches in it."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("cell", "search", "word", "n")))

    def packed(words: list[str], counts: list[int], cell: Cell, at: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        pick = lambda values, places: [values[p] for p in places.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(pick(words, at), pa.string()),
                pa.array(pick(counts, at), pa.int64()),
                pa.array(pick(cell.words, place), pa.string()),
                pa.array(pick(cell.counts, place), pa.int64()),
            ],
            ["a", "a_n", "b", "b_n"],
        )

    def chunks(some: Iterator[tuple]) -> Iterator[tuple[list[str], list[int]]]:
        """Searches of one length, so many at a time."""
        words, counts = [], []
        for _, _, word, n in some:
            if words and (len(words) == SIDE_BY_SIDE or len(word) != len(words[0])):
                yield words, counts
                words, counts = [], []
            words.append(word)
            counts.append(n)
        if words:
            yield words, counts

    for _, of_cell in groupby(rows(), key=lambda row: row[0]):
        cell = None
        for search, some in groupby(of_cell, key=lambda row: row[1]):
            if not search:
                words, counts = (list(part) for part in zip(*((word, n) for _, _, word, n in some)))
                cell = Cell(words, counts)
                for start in range(0, len(words), SIDE_BY_SIDE):
                    at, place = cell.near(cell.letters[start : start + SIDE_BY_SIDE])
                    at, place = at[place > at + start], place[place > at + start]
                    if len(at):
                        yield packed(words, counts, cell, at + start, place)
            elif cell is not None:
                for words, counts in chunks(some):
                    at, place = cell.near(letters_of(words))
                    if len(at):
                        yield packed(words, counts, cell, at, place)


def near_pairs(words: DataFrame, store: Store) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: each pair of words one edit apart, once."""
    ship(words.sparkSession)
    total = words.count()
    some = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < min(1 << 30, int(SAMPLE / max(1, total) * (1 << 30)) + 1)
    cells = Cells([row.word for row in words.where(some).select("word").collect()], total)
    sent = words.mapInArrow(_sent(cells), _SENT)
    dealt = sent.repartition("cell").sortWithinPartitions("cell", "search", F.char_length("word"))
    return store.write("pairs", dealt.mapInArrow(_found, _PAIRS))


# --- Forms ----------------------------------------------------------------


def _roots(forms: DataFrame, store: Store) -> DataFrame:
    """``word`` and ``root``: forms followed to the last, twice as far each round. A form occurs several times as often
    as its word, so chains are short."""
    now, turn = store.write("roots_0", forms.select("word", F.col("form").alias("root"))), 0
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(further, "root", "left")
        if not step.where("next IS NOT NULL").limit(1).count():
            return now
        turn += 1
        now = store.write(f"roots_{turn}", step.select("word", F.coalesce("next", "root").alias("root")))


def variants(words: DataFrame, store: Store) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word of a vocabulary (word, n)."""
    words = store.write("words", words)
    pairs = near_pairs(words, store)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    ruled = words.join(best, "word", "left").withColumn("has_form", F.coalesce(F.col("near_n") >= FORM_TIMES * F.col("n"), F.lit(False)))
    ruled = store.write(
        "forms",
        ruled.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("has_form"), F.col("near")).alias("form"),
            F.when(F.col("has_form"), F.col("near_n")).alias("form_n"),
        ),
    )
    roots = _roots(ruled.where("form IS NOT NULL").select("word", "form"), store)
    return ruled.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
