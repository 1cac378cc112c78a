"""Embedding near-dedup (3): cosine links among vectors of one label, by PCA-ordered tiles.

1. Equal vectors of a label become one, with their number.
2. The principal axes come from the second moments, summed in the tasks. Vectors of unit length are turned onto the
   axes, strongest first: cosines stay, and most of a product lies in its first dimensions.
3. Vectors are sorted by label and first axis and cut into tiles of ``TILE`` rows. Two tiles of a label are compared
   only if the boxes of their first ``BOX`` coordinates come as near as the threshold demands (linked unit vectors
   are at most sqrt(2 - 2 t) apart).
4. A pair of tiles adds up products over leading dimensions first. What remains is at most the product of the
   suffix norms; where even that cannot reach the threshold, the pair of vectors is given up. Survivors
   are decided by their cosine in double precision from the vectors as given.
5. Each pair of tiles returns link counts for its rows and a spanning forest of its links, so what is shuffled
   grows with the rows, not with the links. Forests are joined to components.

Pairs of tiles spread over the tasks, so one label with a third of the rows, or one dense cluster, is many small pieces.
Comparing within a label is still quadratic where vectors lie denser than the threshold: the boxes and the bound
cut it down, never the result.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null,
links with nothing and is its own component; so do vectors of other lengths than those they meet (only
equal lengths are compared). Rows with one ``vec_id`` are separate vectors to count; a null ``vec_id`` is never
the smallest of a component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.tasks import ship
from tallyhouse.sources.store import Store

TILE = 1024
BOX = 6
#: Dimensions that are added up between two looks at the bound.
STEP = 8
#: Allowance for rounding when a pair is given up early; the decision itself has none.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors packed as doubles, one row each; all of one length."""
    return np.array([np.frombuffer(value, np.float64) for value in column.to_pylist()])


def _packed(vector: np.ndarray) -> bytes:
    return np.ascontiguousarray(vector, np.float64).tobytes()


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Row by row: ``vec_id``, ``label``, ``vector`` (doubles as bytes; null if it links with nothing), ``size``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = [], []
            for label, value in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
                ok = label is not None and bool(value) and None not in value
                vector = np.array(value, np.float64) + 0.0 if ok else np.zeros(1)
                with np.errstate(over="ignore", under="ignore"):
                    norm = float(np.sqrt(np.dot(vector, vector)))
                if ok and np.isfinite(vector).all() and vector.any() and not (np.isfinite(norm) and norm > 1e-150):
                    vector = vector / np.abs(vector).max()  # the same direction, without overflow
                    norm = 1.0
                good = ok and np.isfinite(vector).all() and norm > 0
                packed.append(_packed(vector) if good else None)
                sizes.append(len(vector) if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())],
                ["vec_id", "label", "vector", "size"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    given = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return given.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector binary, size int")


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its axes as columns, strongest first; tasks send one matrix of sums each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array(batch.column("size").to_pylist())
            for size in np.unique(sizes).tolist():
                x = _matrix(batch.column("vector").filter(pa.array(sizes == size)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, total in sums.items():
            for row in range(size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size], pa.int32()), pa.array([row], pa.int32()), pa.array([total[row].tolist()], pa.list_(pa.float64()))],
                    ["size", "row", "sums"],
                )

    parts = distinct.mapInArrow(run, "size int, row int, sums array<double>")
    added = (
        parts.select("size", "row", F.posexplode("sums").alias("at", "value"))
        .groupBy("size", "row", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("size", "row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums"))
    )
    moments: dict[int, dict[int, list[float]]] = {}
    for size, row, sums in added.collect():  # as many rows as a vector has dimensions
        moments.setdefault(size, {})[row] = sums
    return {
        size: np.linalg.eigh(np.array([rows[i] for i in range(size)]))[1][:, ::-1].copy() for size, rows in moments.items()
    }


def _tiles(distinct: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """Tiles of vectors of one label and length that are neighbours on the first axis."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = []
            for size, value in zip(batch.column("size").to_pylist(), batch.column("vector").to_pylist()):
                vector = np.frombuffer(value, np.float64)
                first.append(float(vector @ axes[size][:, 0] / np.linalg.norm(vector)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.float64())], [*batch.schema.names, "first"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        group: tuple | None = None

        def flush() -> pa.RecordBatch:
            label, size = group
            x = np.array([np.frombuffer(v, np.float64) for _, _, v in held])
            turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[size][:, :BOX]
            return pa.RecordBatch.from_pydict(
                {
                    "tile": [min(key for key, _, _ in held)],
                    "label": pa.array([label], kind),
                    "size": pa.array([size], pa.int32()),
                    "low": [turned.min(0).tolist()],
                    "high": [turned.max(0).tolist()],
                    "keys": [[key for key, _, _ in held]],
                    "copies": [[n for _, n, _ in held]],
                    "vectors": pa.array([b"".join(v for _, _, v in held)], pa.binary()),
                }
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field("label").type
            columns = (batch.column(name).to_pylist() for name in ("label", "size", "key", "copies", "vector"))
            for label, size, key, copies, vector in zip(*columns):
                if held and (group != (label, size) or len(held) >= tile):
                    yield flush()
                    held = []
                group = (label, size)
                held.append((key, copies, vector))
        if held:
            yield flush()

    kind = distinct.schema["label"].dataType.simpleString()
    placed = distinct.mapInArrow(place, f"label {kind}, size int, vector binary, key long, copies long, first double")
    return (
        placed.repartitionByRange("label", "size", "first", "key")
        .sortWithinPartitions("label", "size", "first", "key")
        .mapInArrow(
            pack,
            f"tile long, label {kind}, size int, low array<double>, high array<double>, keys array<long>, "
            "copies array<long>, vectors binary",
        )
    )


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows of two tiles whose cosine is at least ``threshold``."""
    x_length, y_length = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    u, v = (x / x_length[:, None]) @ axes, (y / y_length[:, None]) @ axes
    u_rest, v_rest = (np.sqrt(np.maximum(0, 1 - np.cumsum(w * w, axis=1))) for w in (u, v))
    size, need = u.shape[1], threshold - SLACK
    done = min(STEP, size)
    dots = u[:, :done] @ v[:, :done].T
    i, j = np.nonzero(dots + np.outer(u_rest[:, done - 1], v_rest[:, done - 1]) >= need)
    dots = dots[i, j]
    while done < size and len(i):
        upto = min(done + STEP, size)
        for start in range(0, len(i), 1 << 18):
            part = slice(start, start + (1 << 18))
            dots[part] += np.einsum("ij,ij->i", u[i[part], done:upto], v[j[part], done:upto])
        done = upto
        stay = dots + u_rest[i, done - 1] * v_rest[j, done - 1] >= need
        i, j, dots = i[stay], j[stay], dots[stay]
    exact = np.concatenate(
        [np.zeros(0)]
        + [
            np.einsum("ij,ij->i", x[i[s : s + (1 << 18)]], y[j[s : s + (1 << 18)]])
            for s in range(0, len(i), 1 << 18)
        ]
    )
    hit = exact / (x_length[i] * y_length[j]) >= threshold
    return i[hit], j[hit]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links among ``n`` nodes."""
    root = list(range(n))

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = top(a), top(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((a, b))
    return kept


def near_vectors(vectors: DataFrame, threshold: float, store: Store, tile: int = TILE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = store.write("vectors", distinct_vectors(vectors))
    shown = rows.where("vector IS NOT NULL")
    distinct = store.write(
        "distinct",
        shown.groupBy("label", "size", "vector").agg(F.count("*").alias("copies")).select(
            "label", "size", "vector", F.xxhash64("label", "vector").alias("key"), "copies"
        ),
    )
    if distinct.agg(F.count("*") - F.countDistinct("key")).first()[0]:
        raise ValueError("Two vectors share a 64-bit key")
    axes = principal_axes(distinct.select("vector", "size"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    tiles = store.write("tiles", _tiles(distinct, axes, tile))

    left, right = (tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("tile", "label", "size", "low", "high")]) for s in "ab")
    box_gap = F.aggregate(
        F.zip_with(
            F.zip_with("low_a", "high_b", lambda a, b: a - b),
            F.zip_with("low_b", "high_a", lambda a, b: a - b),
            lambda p, q: F.greatest(p, q, F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda total, gap: total + gap * gap,
    )
    near = left.join(
        right,
        (F.col("label_a") == F.col("label_b"))
        & (F.col("size_a") == F.col("size_b"))
        & (F.col("tile_a") <= F.col("tile_b"))
        & (F.col("low_a")[0] <= F.col("high_b")[0] + reach)
        & (F.col("low_b")[0] <= F.col("high_a")[0] + reach),
    ).where(box_gap <= reach * reach).select("tile_a", "tile_b", F.col("size_a").alias("size"))
    body = lambda s: tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("tile", "keys", "copies", "vectors")])
    pairs = (
        near.join(body("a"), "tile_a")
        .join(body("b"), "tile_b")
        .select("size", "tile_a", "keys_a", "copies_a", "vectors_a", "tile_b", "keys_b", "copies_b", "vectors_b")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1).to_pylist()[0]
                x, y = (np.frombuffer(row[f"vectors_{s}"], np.float64).reshape(-1, row["size"]) for s in "ab")
                same = row["tile_a"] == row["tile_b"]
                a, b, links = [], [], {}
                n = len(x)
                copies = np.array(row["copies_a"]), np.array(row["copies_b"])
                count_a, count_b = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
                root = np.arange(n if same else n + len(y))
                edges: list[tuple[int, int]] = []
                for start in range(0, n, 256):
                    i, j = linked(x[start : start + 256], y, axes[row["size"]], threshold)
                    i = i + start
                    if same:
                        i, j = i[i < j], j[i < j]
                    np.add.at(count_a, i, copies[1][j])
                    np.add.at(count_b, j, copies[0][i])
                    at_j = j if same else j + n
                    edges = forest(len(root), *(np.array(side, np.int64) for side in zip(*(edges + list(zip(i.tolist(), at_j.tolist())))))) if len(i) else edges
                if same:
                    count_a = count_a + count_b
                keys = row["keys_a"] if same else row["keys_a"] + row["keys_b"]
                counts = count_a if same else np.concatenate([count_a, count_b])
                hit = np.flatnonzero(counts)
                out_a = [keys[p] for p in hit.tolist()] + [keys[p] for p, _ in edges]
                out_b = [None] * len(hit) + [keys[q] for _, q in edges]
                out_n = counts[hit].tolist() + [0] * len(edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], ["a", "b", "links"]
                )

    found = store.write("found", pairs.mapInArrow(compare, "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    stars = components(found.where("b IS NOT NULL").select("a", "b"), store)
    groups = (
        distinct.select("label", "vector", "key", "copies")
        .join(links.withColumnRenamed("a", "key"), "key", "left")
        .join(stars.select(F.col("a").alias("key"), F.col("b").alias("star")), "key", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("star", "key").alias("star"))
    )
    members = rows.select(
        "vec_id", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")).alias("key")
    ).join(groups, "key", "left")
    least = members.where("star IS NOT NULL").groupBy("star").agg(F.min("vec_id").alias("least"))
    return members.join(least, "star", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("star").isNull(), F.col("vec_id")).otherwise(F.col("least")).cast("long").alias("component_id"),
        F.when(F.col("star").isNull(), F.col("vec_id")).otherwise(F.col("least")).eqNullSafe(F.col("vec_id")).alias("kept"),
    )
