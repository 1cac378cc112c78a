"""Merkle dataset manifest (12): checkpoint a few levels of the tree, compute the rest again for proofs.

A leaf is the SHA-256, in hex, of a document's fields. The leaves of a source, in the order of ``doc_id``, stand under a
tree of ``FAN`` children a node; the roots of the sources, in the order of the source, stand under another one, whose
root speaks for the dataset. Only every ``KEPT``-th level is stored: leaves, then nodes over ``FAN ** KEPT`` of them, and
so on. A proof needs the siblings on all levels. They are computed anew, top down: an aligned subtree of stored nodes is
one row, which folds its own interior levels, writes for each of its nodes the siblings on the way up, puts the way of its
own top behind them, and forgets the interior. So proofs of all documents cost one pass over the stored nodes and never hold
more than a subtree (``FAN ** KEPT`` hashes) in a row.

Places in a source come from a range sort and a running sum over (task, source) counts, so a source with most of the rows is
spread like any other. Text is read once and never moves; only hashes do. Everything is DataFrame functions.

Defined results: a null field hashes as ``-``; null ids come first, rows with one id by their hash, so repeated rows are leaves
of their own; a null source is a source, the first one; an empty table has no root and no proofs. Columns that are
not named are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.store import Store

FAN = 16
#: Levels from one stored level to the next; a subtree of FAN ** KEPT nodes is worked on in one row.
KEPT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(column: Column) -> Column:
    """A field as it is hashed: byte count, colon, value; a dash if there is none."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def sorted_runs(rows: DataFrame, group: list[str], order: list[Column], store: Store, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows range-sorted by group and order, and a row for each (task, group): what to add to ``at`` to get
    the place in the group, and the group's size."""
    keys = [F.col(name).asc_nulls_first() for name in group] + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = store.write(f"{label}_sorted", placed).withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy("task", *group).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*group)  # a row for each task that has rows of the group
    earlier = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "task",
        *group,
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("places"),
    )
    return placed, store.write(f"{label}_runs", runs)


def numbered(placed: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """The sorted rows with ``place`` in their group (from 0) and what else their run has. Equal rows get places of their own."""
    renamed = runs.withColumnsRenamed({name: f"run_{name}" for name in ["task", *group]})
    same = F.col("task") == F.col("run_task")
    for name in group:
        same = same & F.col(name).eqNullSafe(F.col(f"run_{name}"))
    joined = placed.join(renamed, same).withColumn("place", F.col("at") + F.col("shift"))
    return joined.drop("at", "task", "shift", *[f"run_{name}" for name in ["task", *group]])


def _folded(hashes: Column) -> Column:
    """The next level: the hash of every FAN hashes that follow each other."""
    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / F.lit(FAN)).cast("int"))
    return F.transform(starts, lambda r: F.sha2(F.array_join(F.slice(hashes, r * FAN + 1, F.lit(FAN)), ""), 256))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """A row for each aligned subtree of stored nodes: ``members`` in order and each level's hashes and group size.

    A group that is down to one node has reached its top; its level then passes unchanged.
    """
    width = FAN**KEPT
    rows = nodes.groupBy("grp", F.expr(f"idx div {width}").alias("sub")).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in ("idx", "hash", "kept") if c in nodes.columns]))).alias("members"),
        F.max("n").alias("n_0"),
    )
    rows = rows.withColumn("level_0", F.col("members.hash"))
    for j in range(KEPT):
        rows = rows.withColumn(f"n_{j + 1}", F.expr(f"(n_{j} + {FAN - 1}) div {FAN}")).withColumn(
            f"level_{j + 1}", F.when(F.col(f"n_{j}") > 1, _folded(F.col(f"level_{j}"))).otherwise(F.col(f"level_{j}"))
        )
    return rows


def grow(nodes: DataFrame, most: int, store: Store, label: str) -> list[DataFrame]:
    """The stored levels over ``nodes`` (grp, idx, hash, n: nodes of the group); ``most`` is the largest n."""
    kept = [nodes]
    while most > 1:
        tops = _subtrees(kept[-1].where("n > 1").select("grp", "idx", "hash", "n")).select(
            "grp", F.col("sub").alias("idx"), F.get(f"level_{KEPT}", F.lit(0)).alias("hash"), F.col(f"n_{KEPT}").alias("n")
        )
        kept.append(store.write(f"{label}_{len(kept)}", tops))
        for _ in range(KEPT):
            most = -(-most // FAN)
    return kept


def tops(kept: list[DataFrame]) -> DataFrame:
    """grp and hash of each group's root."""
    out = None
    for level in kept:
        part = level.where("n = 1").select("grp", "hash")
        out = part if out is None else out.unionByName(part)
    return out


def _way(level: Column, place: Column) -> Column:
    """The siblings of a place on one level, those before it and those after it."""
    within = place % FAN
    return F.struct(
        F.array_join(F.slice(level, place - within + 1, within), "").alias("before"),
        F.array_join(F.slice(level, place + 2, F.lit(FAN - 1) - within), "").alias("after"),
    )


def ways(kept: list[DataFrame], above: DataFrame, store: Store, label: str) -> DataFrame:
    """The nodes of the lowest stored level with ``way``, the siblings from there to the root, level by level, and ``top``.

    ``above`` (grp, way, top) holds what follows the group's own root, and that root. Interior levels exist only inside
    a subtree's row.
    """
    known = None
    for k in range(len(kept) - 1, -1, -1):
        level = kept[k]
        columns = [c for c in ("grp", "idx", "hash", "kept") if c in level.columns]
        roots = level.where("n = 1").join(above, "grp").select(*columns, "way", "top")
        if known is not None:
            rows = _subtrees(level.where("n > 1")).join(
                known.select("grp", F.col("idx").alias("sub"), F.col("way").alias("rest"), "top"), ["grp", "sub"]
            )

            def of_member(member: Column, at: Column) -> Column:
                places = [F.floor(at / F.lit(FAN**j)).cast("int") for j in range(KEPT)]
                own = [F.when(F.col(f"n_{j}") > 1, _way(F.col(f"level_{j}"), places[j])) for j in range(KEPT)]
                found = F.concat(F.array_compact(F.array(*own)), F.col("rest"))
                return F.struct(*[member[c].alias(c) for c in columns if c != "grp"], found.alias("way"))

            inner = rows.select("grp", "top", F.inline(F.transform("members", of_member)))
            roots = inner.select(*columns, "way", "top").unionByName(roots)
        known = store.write(f"{label}_ways_{k}", roots) if k else roots
    return known


@dataclass
class Manifest:
    """What is stored: the levels under the source roots, the levels over them, and the root of all."""

    store: Store
    sources: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """Each document's kept columns with ``leaf``, ``subroot``, ``root`` and ``way``, its siblings up to the root."""
        nothing = F.expr("CAST(array() AS array<struct<before: string, after: string>>)")
        root = F.lit(self.root).cast("string")
        above = self.over[0].select("grp").distinct().select("grp", nothing.alias("way"), root.alias("top"))
        of_source = ways(self.over, above, self.store, "over")
        of_source = self.store.write("source_ways", of_source.select(F.col("idx").alias("grp"), "way", F.col("hash").alias("top")))
        leaves = ways(self.sources, of_source, self.store, "leaf")
        return leaves.select("kept.*", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "way")


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(way, leaf, lambda value, step: F.sha2(F.concat(step["before"], value, step["after"]), 256))


def proof_hash(way: Column) -> Column:
    """The hash of all siblings on the way, level by level."""
    return F.sha2(F.array_join(F.transform(way, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def write_manifest(docs: DataFrame, store: Store, **claims: Column) -> Manifest:
    """Hash the documents and store the manifest. ``claims`` are more columns that proofs bring back."""
    hashed = docs.select(
        F.col("doc_id"), F.col("source"), leaf_hash(*map(F.col, FIELDS)).alias("hash"), *[c.alias(name) for name, c in claims.items()]
    )
    hashed = store.write("hashed", hashed)
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), *[F.col(name).asc_nulls_first() for name in claims]]
    placed, runs = sorted_runs(hashed, ["source"], order, store, "leaf")
    found = runs.groupBy("source").agg(F.max("places").alias("n"))
    sources = numbered(*sorted_runs(found, [], [F.col("source").asc_nulls_first()], store, "source"), [])
    sources = store.write("sources", sources.select("source", F.col("place").alias("grp"), "n", "places"))
    size = sources.agg(F.max("n").alias("most"), F.max("places").alias("sources")).first()
    named = sources.select(F.col("source").alias("name"), "grp")
    runs = runs.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    leaves = numbered(placed, runs, ["source"]).select(
        "grp",
        F.col("place").alias("idx"),
        "hash",
        F.col("places").alias("n"),
        F.struct("doc_id", "source", *claims).alias("kept"),
    )
    kept = grow(store.write("leaves", leaves), size.most or 0, store, "leaf_level")
    subroots = store.write("subroots", tops(kept).join(sources, "grp").select("grp", "source", "hash", "places"))
    nodes = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), "hash", F.col("places").alias("n"))
    over = grow(nodes, size.sources or 0, store, "over_level")
    root = tops(over).first()
    return Manifest(store, kept, over, subroots.select("source", "hash"), root.hash if root else None)
