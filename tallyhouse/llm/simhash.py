"""SimHash near-dedup (6): fingerprints that differ in few bits, by deletion variants of their segments.

A fingerprint of ``BITS`` bits is cut into so few segments that two fingerprints within the distance agree in one of
them but for one bit at most: distance // 2 + 1 segments. Each segment is indexed under its one-wildcard variants (the
segment without one of its bits, and which one), so such a pair shares a variant: an equality on the key. What shares a
key is verified by the distance of the whole fingerprints.

Work is done on distinct fingerprints; copies only add members to them. Rows of one key lie sorted side by side in one
partition and are read as a stream. A key with more than ``HOT`` fingerprints is handed on: its members are dealt
into blocks, and each pair of blocks is a group of its own on another task, so no key is cut short and none
fills a task. From each group come the links of a spanning forest, not all pairs.

Defined results: a null or empty text has fingerprint zero and links like any other; a text with fewer words than a
shingle is one shingle; ``component_id`` is the smallest ``doc_id`` of the component, null ids aside. Repeated
rows are each answered. Only A-Z are lowered; words end at ASCII white space only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.tasks import bounded, free_name, ship, texts
from tallyhouse.sources.store import Store

BITS = 64
SEED = 42
#: A key with more fingerprints is compared block by block, on several tasks.
HOT = 4096
#: Rows that are looked at together; keys are far smaller, so most batches end between keys.
ROWS = 1 << 16
#: Shingles whose bits are added up together.
SHINGLES = 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words: int = 4) -> int:
    """The fingerprint of a text by shingles of ``words`` words."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        some = np.array(hashes[at : at + SHINGLES], "<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, *also: str) -> DataFrame:
    """``doc_id``, the columns of ``also``, and ``print``, the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            made = np.array([fingerprint(text, words) for text in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(made)], [*kept, "print"])

    kept = ["doc_id", *also]
    kinds = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, print long")


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: with these, some segment differs by one bit at most."""
    count = distance // 2 + 1
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, distance: int) -> DataFrame:
    """A row for each one-wildcard variant: ``place`` (the wildcard's bit names segment and bit), ``rest``, ``print``."""
    masks = []
    for first, width in segments(distance):
        whole = ((1 << width) - 1) << first
        for bit in range(first, first + width):
            mask = whole & ~(1 << bit)
            masks.append((bit, mask - (1 << 64) if mask >> 63 else mask))
    index = F.array(*[F.struct(F.lit(bit).cast("byte").alias("place"), F.lit(mask).cast("long").alias("mask")) for bit, mask in masks])
    one = prints.select("print", F.explode(index).alias("v"))
    return one.select(F.col("v.place").alias("place"), F.col("print").bitwiseAND(F.col("v.mask")).alias("rest"), "print")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def _group_forest(prints: np.ndarray, distance: int, split: int = 0) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of one group; with ``split``, only of links from before it to behind it.

    Each fingerprint is taken from the rest once and compared with all that are left.
    """
    left, right = [], []
    n = len(prints)
    side = np.arange(n) >= split if split else None
    open_ = np.arange(n)
    while len(open_):
        ring, open_ = [int(open_[0])], open_[1:]
        while ring and len(open_):
            node = ring.pop()
            near = _distance(prints[open_], prints[node]) <= distance
            if side is not None:
                near &= side[open_] != side[node]
            if near.any():
                got = open_[near].tolist()
                left += [int(prints[node])] * len(got)
                right += prints[got].tolist()
                ring += got
                open_ = open_[~near]
    return left, right


def _near_neighbours(place: np.ndarray, rest: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows of small groups: each row against the next, the one after, and so on in its group."""
    left, right = [], []
    rows, step = np.arange(len(prints) - 1), 1
    while len(rows):
        rows = rows[rows + step < len(prints)]
        rows = rows[(rest[rows] == rest[rows + step]) & (place[rows] == place[rows + step])]
        near = rows[_distance(prints[rows], prints[rows + step]) <= distance]
        left.append(prints[near])
        right.append(prints[near + step])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (prints[:0], prints[:0])


def _rows(a, b, kind: int, place=None) -> pa.RecordBatch:
    n = len(a)
    place = np.full(n, 0, np.int8) if place is None else place
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array(place, pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
        ["kind", "place", "a", "b"],
    )


def _verified(variant_rows: DataFrame, distance: int, hot: int) -> DataFrame:
    """Kind 0: links ``a``, ``b``. Kind 1: members ``b`` of a hot key (``place``, ``a``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        overflowing: tuple[int, int] | None = None

        def links(place, rest, prints) -> Iterator[pa.RecordBatch]:
            if not len(prints):
                return
            starts = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (place[1:] != place[:-1])])
            sizes = np.diff(np.r_[starts, len(rest)])
            small = np.repeat(sizes <= 32, sizes)
            a, b = _near_neighbours(place[small], rest[small], prints[small], distance)
            a, b = a.tolist(), b.tolist()
            for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
                more_a, more_b = _group_forest(prints[start : start + size], distance)
                a += more_a
                b += more_b
            if a:
                pairs = np.unique(np.sort(np.array([a, b], np.int64), axis=0), axis=1)
                yield _rows(pairs[0], pairs[1], 0)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Work off the held keys; the last one may go on in the next batch."""
            nonlocal held, overflowing
            place, rest, prints = held
            if not len(rest):
                return
            if overflowing is not None:
                n = int(np.argmin(np.r_[(rest == overflowing[1]) & (place == overflowing[0]), False]))
                if n:
                    yield _rows(rest[:n], prints[:n], 1, place[:n])
                place, rest, prints = place[n:], rest[n:], prints[n:]
                if len(rest):
                    overflowing = None
            starts = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (place[1:] != place[:-1])]) if len(rest) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(rest)]).astype(np.int64)
            large = np.repeat(sizes > hot, sizes)
            if large.any():
                yield _rows(rest[large], prints[large], 1, place[large])
                if large[-1]:
                    overflowing = (int(place[-1]), int(rest[-1]))
            open_from = len(rest) if last or not len(rest) or large[-1] else int(starts[-1])
            ready = ~large
            ready[open_from:] = False
            yield from links(place[ready], rest[ready], prints[ready])
            held = [c[open_from:] for c in (place, rest, prints)]

        for batch in batches:
            new = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("place", "rest", "print")]
            held = [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]) >= ROWS:
                yield from settle(False)
        yield from settle(True)

    sorted_rows = variant_rows.repartition("place", "rest").sortWithinPartitions("place", "rest", "print")
    return sorted_rows.mapInArrow(run, "kind byte, place byte, a long, b long")


def _hot_links(members: DataFrame, distance: int, hot: int) -> DataFrame:
    """Links within hot keys: members in blocks of about half of ``hot``, each pair of blocks a group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            one, two = (np.array(side, np.int64) for side in sides)
            same = group is not None and group[2] == group[3]
            a, b = _group_forest(one if same else np.concatenate([one, two]), distance, 0 if same else len(one))
            if a:
                yield _rows(a, b, 0)

        for batch in batches:
            names = ("place", "rest", "low", "high", "block", "print")
            for place, rest, low, high, block, print_ in zip(*(batch.column(n).to_pylist() for n in names)):
                if group != (place, rest, low, high):
                    if group is not None:
                        yield from flush()
                    group, sides = (place, rest, low, high), ([], [])
                sides[block != low].append(print_)
        if group is not None:
            yield from flush()

    keyed = members.select("place", F.col("a").alias("rest"), F.col("b").alias("print"))
    counted = keyed.groupBy("place", "rest").agg(F.ceil(F.count("*") / F.lit(max(1, hot // 2))).cast("int").alias("blocks"))
    dealt = keyed.join(counted, ["place", "rest"]).withColumn("block", F.expr("int(pmod(xxhash64(print), blocks))"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "place", "rest", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "print"
    )
    keys = ["place", "rest", "low", "high"]
    return (
        paired.repartition(*keys).sortWithinPartitions(*keys, "print").mapInArrow(run, "kind byte, place byte, a long, b long")
    )


def _classes(prints: DataFrame, distance: int, store: Store, hot: int) -> DataFrame:
    """``print`` and ``star``, the print that names its component, for each of the ``prints``."""
    found = store.write("found", _verified(variants(prints.select("print").distinct(), distance), distance, hot))
    links = found.where("kind = 0").select("a", "b")
    members = found.where("kind = 1")
    if not members.isEmpty():
        links = links.unionByName(store.write("hot", _hot_links(members, distance, hot)).select("a", "b"))
    return components(links, store).select(F.col("a").alias("print"), F.col("b").alias("star"))


def near_texts(docs: DataFrame, words: int, distance: int, store: Store, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` for each row of ``docs``."""
    prints = store.write("prints", fingerprints(docs, words))
    stars = _classes(prints, distance, store, hot)
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    grouped = least.join(stars, "print", "left").withColumn("star", F.coalesce("star", "print"))
    smallest = grouped.groupBy("star").agg(F.min("least").alias("component_id"))
    classes = grouped.join(smallest, "star").select("print", "component_id")
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, words: int, distance: int, store: Store, hot: int = HOT) -> DataFrame:
    """The documents, one row of each component: of those with its smallest ``doc_id``, the one whose whole row hashes least.

    Unlike texts with one ``doc_id`` are rows of their own components. Rows without a ``doc_id`` all stay.
    """
    own, kept_id, kept_row = (free_name(docs, name) for name in ("row_hash", "kept_id", "kept_row"))
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    hashed = docs.withColumn(own, F.xxhash64(*columns, *[c.isNull() for c in columns]))
    prints = store.write("prints", fingerprints(hashed, words, own))
    stars = _classes(prints, distance, store, hot)
    first = F.min(F.struct("doc_id", own)).alias("first")
    least = prints.where("doc_id IS NOT NULL").groupBy("print").agg(first)
    grouped = least.join(stars, "print", "left").withColumn("star", F.coalesce("star", "print"))
    rows = grouped.groupBy("star").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias(kept_id), F.col(f"first.{own}").alias(kept_row)
    )
    same = (F.col("doc_id") == F.col(kept_id)) & (F.col(own) == F.col(kept_row))
    stay = hashed.join(rows, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return stay.unionByName(docs.where("doc_id IS NULL"))
