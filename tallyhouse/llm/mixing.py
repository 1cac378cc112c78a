"""Mixing sources to target weights (7) as a time-varying curriculum.

Each source has a target of words and a schedule: its weight over training time t in [0, 1] is its share times
``1 + ramp (2 t - 1)``. The integral of the schedule is the source's cumulative demand; a document that stands at some
share of its source's words gets the time at which the demand reaches it, and documents are sorted by that
position over a range-partitioned sort.

Documents of a source follow each other in an order drawn from their ids; a second pass over the source follows the
first where the target is above its words. A pass takes a document if the middle of its words lies before the target,
so a source misses its target by half a document at most, and none is taken more than twice.

The running sums take two steps: documents are dealt into ``2 ** BUCKET_BITS`` buckets of the drawn order for each
source, buckets are added up before anything is shuffled, and only rows of one bucket are sorted together. A
source with a third of all rows is so many small groups. Rows without an id have one place in the drawn order, where they
follow each other by size; they are groups by size and, within a size, by a hash of the text. Sizes are written once, so texts
are read once.

Defined results: a null text has no words and is taken with none; a null source is a source of its own, the last one; a
source without words has target 0; an empty table gives an empty plan; rows with one ``doc_id`` count each, and
ties among them are rows that are alike. Columns other than doc_id, text and source are not looked at. Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.store import Store

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12
KEY_BITS = 60
#: Groups that rows without an id and of one size are dealt into.
NAMELESS_GROUPS = 64


#: Weights and ramps of the sources, repeating; what all of them share of all words; how often a document is taken at most.
WEIGHTS, RAMPS, TOTAL_SHARE, MOST = (5, 2, 1), (-0.5, 0.0, 0.5), 1.5, 2


def drawn(doc_id: Column) -> Column:
    """A number of 60 bits that depends on the id only."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """``rank``, ``weight`` and ``target`` for each source (``src``, ``nameless``, ``source_size``), one row each.

    Filling up by weight: with sources in order of the level at which they are full, the common level is the highest of
    those that result when the first sources are full and the others share the rest.
    """
    names = Window.orderBy("nameless", "src")
    ranked = sources.withColumn("rank", F.row_number().over(names) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("full", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    wanted = F.lit(float(total_share)) * F.sum("source_size").over(everything)
    level = ranked.withColumn("level", (wanted - before) / rest)
    return level.withColumn("target", F.least("full", F.col("weight") * F.max("level").over(everything))).select(
        "src", "source_size", "rank", "weight", "target"
    )


def plan(
    docs: DataFrame,
    store: Store,
    weights: Sequence[float] = WEIGHTS,
    ramps: Sequence[float] = RAMPS,
    total_share: float = TOTAL_SHARE,
    most: int = MOST,
    also: Sequence[str] = (),
) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, ``positions``, one for each time taken, and ``also``.

    Columns named in ``also`` come along with their row, under their own names.
    """
    placed = _placed(docs, store, weights, ramps, total_share, most, also)
    names = [F.col(f"also_{at}").alias(name) for at, name in enumerate(also)]
    return placed.select("doc_id", "source", "size", "source_size", "target", "positions", *names)


def _placed(
    docs: DataFrame, store: Store, weights: Sequence[float], ramps: Sequence[float], total_share: float, most: int, also: Sequence[str]
) -> DataFrame:
    """The plan; what comes along is named ``also_0`` and so on. It moves once, to its bucket."""
    sized = store.write(
        "sized",
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            drawn(F.col("doc_id")).alias("draw"),
            F.pmod(F.xxhash64("text"), F.lit(NAMELESS_GROUPS)).cast("int").alias("dealt"),
            *[F.col(f"`{name}`").alias(f"also_{at}") for at, name in enumerate(also)],
        )
        .withColumn("bucket", F.shiftright("draw", KEY_BITS - BUCKET_BITS).cast("int"))
        # Within the bucket of null ids: what is drawn before them, they by size, what is drawn after them.
        .withColumn("part", F.when(F.col("doc_id").isNull(), 1).when(F.col("draw") < drawn(F.lit(None)), 0).otherwise(2))
        .withColumn("part", F.when(F.col("bucket") == F.shiftright(drawn(F.lit(None)), KEY_BITS - BUCKET_BITS), F.col("part")).otherwise(0))
        .withColumn("level", F.when(F.col("doc_id").isNull(), F.col("size")).otherwise(0))
        .withColumn("dealt", F.when(F.col("doc_id").isNull(), F.col("dealt")).otherwise(0)),
    )
    group = ["bucket", "part", "level", "dealt"]
    buckets = sized.groupBy("src", *group).agg(F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("src").agg(F.sum("bucket_size").alias("source_size"))
    aims = targets(sources.withColumn("nameless", F.col("src") == ""), weights, total_share, most)
    so_far = Window.partitionBy("src").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0))).join(aims, "src")
    ramp = F.element_at(F.array(*[F.lit(float(r)) for r in ramps]), (F.col("rank") % len(ramps) + 1).cast("int"))
    placed = sized.join(offsets.drop("bucket_size").withColumn("ramp", ramp), ["src", *group])
    inside = Window.partitionBy("src", *group).orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2

    def position(turn: int) -> Column:
        at = F.col("middle") + turn * F.col("source_size")
        share = at / F.col("target")
        flat = 1 - F.col("ramp")
        return F.when(at < F.col("target"), 2 * share / (flat + F.sqrt(flat * flat + 4 * F.col("ramp") * share)))

    return placed.withColumn("middle", middle).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.array_compact(F.array(*[position(turn) for turn in range(most)])).alias("positions"),
        *[f"also_{at}" for at in range(len(also))],
    )


def mixed(
    docs: DataFrame,
    store: Store,
    weights: Sequence[float] = WEIGHTS,
    ramps: Sequence[float] = RAMPS,
    total_share: float = TOTAL_SHARE,
    most: int = MOST,
) -> DataFrame:
    """The documents in training order, a row for each time one is taken, with the columns they had.

    All columns go with their row through the plan, so each row is taken as planned for it, whatever its ``doc_id``.
    """
    placed = _placed(docs, store, weights, ramps, total_share, most, docs.columns)
    columns = [F.col(f"also_{at}").alias(name) for at, name in enumerate(docs.columns)]
    taken = placed.select("doc_id", *[f"also_{at}" for at in range(len(docs.columns))], F.explode("positions").alias("position"))
    return taken.orderBy("position", "doc_id").select(*columns)
