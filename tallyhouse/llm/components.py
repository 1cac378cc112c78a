"""Connected components of a table of links, by large and small stars.

A round turns each node's larger neighbours to its smallest one, then its smaller ones likewise, until every
component is a star around its smallest node. Both sides of a round are written to the shared folder, so a lost
executor costs a re-read; links never come to the driver, only their number and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.store import Store


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("least"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, store: Store, label: str = "star") -> DataFrame:
    """``a`` and ``b``: each linked node but the smallest of its component, and that smallest node.

    ``links`` has two orderable columns of one kind, not null. The order within a row and repeated rows do not matter.
    """
    now = (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    now, last, turn = store.write(f"{label}_0", now), None, 0
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == last or not seen[0]:
            return now
        turn, last = turn + 1, tuple(seen)
        now = store.write(f"{label}_{turn}", _small_star(_large_star(now)))
