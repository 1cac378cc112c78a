"""A kept inverted index: text is read once, when chunks are added; searches read postings and skip most of them.

Chunks come in segments. A segment's postings are bucketed by term (and a salt, so a term of every chunk fills no
bucket alone) and kept in blocks of up to ``BLOCK`` chunks; a block knows its greatest term count and
shortest chunk, which bound what any of its chunks can score, whatever the average length becomes. Chunks are put
into blocks by length, so bounds are tight. Adding a segment or deleting chunks commits a new version of the index;
document frequencies and lengths are summed over segments, so ranks are those of an index built anew.

A search works out, for each query, a score that the k-th best chunk reaches at least, from chunks that hold its rarest
terms. Terms that cannot reach it all together are then set aside: only chunks with one of the other terms can be
among the best. Their scores so far, and the bounds of the blocks of the terms set aside, leave few chunks
to be scored in full. Nothing is approximate: ranks and scores are those of ``bm25.search``.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.operators import bm25
from tallyhouse.sources.store import Store
from tallyhouse.sources.versions import Version, Versions

BLOCK = 16
#: Buckets of a segment, and salts that a term's blocks are dealt over, at least.
BUCKETS, SALTS = 8, 8
#: Postings of a bucket, which one task sorts, and chunks for each salt, which bound the postings of a term and salt; a
#: larger segment has more buckets and salts.
BUCKET_POSTINGS, SALT_CHUNKS = 1_000_000, 100_000
#: Segments that are merged into one; a search plans a join for each.
MOST_SEGMENTS = 8
#: Chunk ids marked as deleted that are broadcast at most; more are taken out by a merge.
MOST_MARKS = 500_000
#: A query's rarest terms are taken until they have so many postings; the best chunks of those set the score to beat.
SEED_POSTINGS, SEED_CHUNKS = 400, 16
#: Scores that round alike must not be told apart by a bound.
SLACK = 10.0 ** -bm25.RANK_DECIMALS

_PAIR = ["query_id", "segment", "block"]


def _weight(tf: Column, dl: Column, avgdl: float) -> Column:
    """What one unit of IDF is worth; grows with the term's count and falls with the chunk's length."""
    return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / F.lit(avgdl)))


@dataclass
class Found:
    """The best chunks of a search, and how many (query, chunk) pairs were scored in full to find them."""

    best: DataFrame
    scored: DataFrame


class PassageIndex:
    """One version of the index in a folder."""

    def __init__(self, spark: SparkSession, folder: str, version: Version, buckets: int = BUCKETS, block: int = BLOCK):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.versions = Versions(spark, self.folder)
        self.version = version
        self.buckets = version.content.get("buckets", buckets)
        self.block = version.content.get("block", block)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int = BUCKETS, block: int = BLOCK) -> "PassageIndex":
        """The latest version; an empty one if there is none. Settings count for a new index only."""
        return cls(spark, folder, Versions(spark, folder).latest(), buckets, block)

    @property
    def segments(self) -> list[dict]:
        return self.version.content.get("segments", [])

    @property
    def chunks(self) -> int:
        return sum(segment["chunks"] for segment in self.segments)

    @property
    def tokens(self) -> int:
        return sum(segment["tokens"] for segment in self.segments)

    # --- Tables ---

    def _postings(self, segment: dict) -> DataFrame:
        """term, salt, block, most_tf, least_dl, hits; read bucket by bucket."""
        table = f"passages_{segment['name']}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({segment['schema']}) USING parquet "
                f"CLUSTERED BY (term, salt) SORTED BY (term, salt) INTO {segment.get('buckets', self.buckets)} BUCKETS "
                f"LOCATION '{self.folder}/{segment['name']}/postings'"
            )
        return self.spark.table(table)

    def _counts(self, segment: dict) -> DataFrame:
        """chunk_id, dl, counts, block: what was counted when the segment was added."""
        return self.spark.read.parquet(f"{self.folder}/{segment['name']}/counts")

    def _marks(self, segment: dict) -> DataFrame | None:
        """chunk_id and block of the segment's deleted chunks."""
        if not segment["deleted"]:
            return None
        return self.spark.read.parquet(*(f"{self.folder}/{name}/ids" for name in segment["deleted"]))

    def _live(self, segment: dict) -> DataFrame:
        """What was counted of the chunks that are not deleted."""
        counts, marks = self._counts(segment), self._marks(segment)
        return counts if marks is None else counts.join(marks.select("chunk_id"), "chunk_id", "left_anti")

    def _terms(self) -> DataFrame:
        """term, df, most_tf, least_dl over all segments, deleted chunks taken off the df."""
        parts = [self.spark.read.parquet(f"{self.folder}/{s['name']}/terms") for s in self.segments]
        gone = {name for s in self.segments for name in s["deleted"]}
        parts += [self.spark.read.parquet(f"{self.folder}/{name}/terms") for name in sorted(gone)]
        whole = reduce(DataFrame.unionByName, parts).groupBy("term")
        return whole.agg(F.sum("df").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl")).where("df > 0")

    def term_stats(self) -> DataFrame:
        """term, df, idf, avgdl as ``bm25.term_stats`` gives them."""
        if not self.chunks:
            return self.spark.sql("SELECT '' AS term, 0L AS df, 0D AS idf, 0D AS avgdl WHERE false")
        idf = bm25._idf(F.lit(self.chunks), F.col("df"))
        return self._terms().select("term", "df", idf.alias("idf"), F.lit(self.tokens / self.chunks).alias("avgdl"))

    # --- Changes ---

    def _written(self, rows: DataFrame) -> dict | None:
        """A segment of rows (chunk_id, dl, counts), not yet in any version. Nothing for no rows."""
        name = f"s{uuid.uuid4().hex}"
        store = Store(self.spark, f"{self.folder}/{name}")
        placed = rows.sortWithinPartitions("dl").withColumn("block", F.expr(f"monotonically_increasing_id() div {self.block}"))
        placed = store.write("counts", placed)
        postings = F.sum(F.size("counts")).alias("postings")
        sizes = placed.agg(F.count("*").alias("chunks"), F.sum("dl").alias("tokens"), postings).first()
        if not sizes.chunks:
            return None
        buckets = max(self.buckets, math.ceil((sizes.postings or 0) / BUCKET_POSTINGS))
        salts = max(SALTS, math.ceil(sizes.chunks / SALT_CHUNKS))
        listed = bm25._listed(placed, ["chunk_id", "dl", "block"], F.col("counts"), "term")
        salted = listed.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        blocks = (
            salted.repartition(buckets, "term", "salt")
            .groupBy("term", "salt", "block")
            .agg(
                F.max("tf").alias("most_tf"),
                F.min("dl").alias("least_dl"),
                F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "dl"))).alias("hits"),
            )
        )
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
        segment = {"name": name, "schema": schema, "buckets": buckets, "salts": salts, "deleted": []}
        table = f"passages_{name}"
        writer = blocks.write.bucketBy(buckets, "term", "salt").sortBy("term", "salt")
        writer.option("path", store.path("postings")).saveAsTable(table)
        terms = self._postings(segment).groupBy("term").agg(
            F.sum(F.size("hits")).alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl")
        )
        store.write("terms", terms)
        return segment | {"chunks": sizes.chunks, "tokens": sizes.tokens or 0}

    def _committed(self, change) -> "PassageIndex":
        """The index after a change of its segments, on top of what others have committed."""

        def make(now: Version) -> dict | None:
            segments = change(now.content.get("segments", []))
            return None if segments is None else {"buckets": self.buckets, "block": self.block, "segments": segments}

        return PassageIndex(self.spark, self.folder, self.versions.change(make))

    def add(self, chunks: DataFrame) -> "PassageIndex":
        """Index more chunks (chunk_id, heading, text), whose ids are not in the index yet."""
        segment = self._written(bm25.term_counts(chunks, "chunk_id", bm25.index_text()))
        after = self._committed(lambda now: None if segment is None else [*now, segment])
        return after.merge() if len(after.segments) > MOST_SEGMENTS else after

    def delete(self, ids: DataFrame) -> "PassageIndex":
        """Take chunks out (``chunk_id``); ids that are not in the index change nothing.

        Marks count for the segments of this version; chunks added later under the same ids stay.
        """
        ids, changed = ids.select("chunk_id").distinct(), {}
        for segment in self.segments:
            name = f"d{uuid.uuid4().hex}"
            store = Store(self.spark, f"{self.folder}/{name}")
            gone = self._live(segment).join(ids, "chunk_id", "left_semi")
            sizes = gone.agg(F.count("*").alias("chunks"), F.sum("dl").alias("tokens")).first()
            if not sizes.chunks:
                continue
            store.write("ids", gone.select("chunk_id", "block"))
            lost = bm25._listed(gone, ["chunk_id"], F.col("counts"), "term").groupBy("term").agg(F.count("*").alias("n"))
            nothing = F.lit(None).cast("int")
            store.write("terms", lost.select("term", (-F.col("n")).alias("df"), nothing.alias("most_tf"), nothing.alias("least_dl")))
            changed[segment["name"]] = name, sizes

        def change(now: list[dict]) -> list[dict] | None:
            if not changed:
                return None
            out = []
            for segment in now:
                if segment["name"] in changed:
                    name, sizes = changed[segment["name"]]
                    segment = segment | {
                        "deleted": [*segment["deleted"], name],
                        "chunks": segment["chunks"] - sizes.chunks,
                        "tokens": segment["tokens"] - (sizes.tokens or 0),
                    }
                out.append(segment)
            return out

        after = self._committed(change)
        return after.merge() if any(sizes.chunks > MOST_MARKS for _, sizes in changed.values()) else after

    def merge(self) -> "PassageIndex":
        """All segments as one, without deleted chunks. Counts are read, no text. Segments that others have
        added meanwhile stay beside it."""
        if not self.segments:
            return self
        rows = reduce(DataFrame.unionByName, (self._live(segment) for segment in self.segments))
        segment = self._written(rows.drop("block"))
        merged = {s["name"]: s["deleted"] for s in self.segments}

        def change(now: list[dict]) -> list[dict] | None:
            same = {s["name"]: s["deleted"] for s in now if s["name"] in merged}
            if same != merged:
                return None  # chunks of these segments were deleted meanwhile: they stay as they are
            others = [s for s in now if s["name"] not in merged]
            return others + ([segment] if segment else [])

        return self._committed(change)

    # --- Search ---

    def _asked(self, asked: DataFrame, blocks_of: DataFrame | None = None) -> DataFrame:
        """Blocks of asked terms (query_id, term, w): query_id, segment, block, w, most_tf, least_dl, hits.

        The terms asked for are repeated for each salt and meet the buckets; postings do not move.
        """
        parts = []
        for segment in self.segments:
            salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(segment.get("salts", SALTS) - 1))))
            found = self._postings(segment).join(salted, ["term", "salt"]).withColumn("segment", F.lit(segment["name"]))
            marks = self._marks(segment)
            if marks is not None:  # MOST_MARKS ids at most
                gone = marks.groupBy("block").agg(F.collect_list("chunk_id").alias("gone"))
                live = F.expr("filter(hits, h -> NOT array_contains(gone, h.chunk_id))")
                found = found.join(F.broadcast(gone), "block", "left").withColumn("hits", F.when(F.col("gone").isNull(), F.col("hits")).otherwise(live))
            parts.append(found.select(*_PAIR, "w", "most_tf", "least_dl", "hits"))
        found = reduce(DataFrame.unionByName, parts)
        return found if blocks_of is None else found.join(blocks_of.select(*_PAIR).distinct(), _PAIR, "left_semi")

    def _sums(self, blocks: DataFrame, avgdl: float) -> DataFrame:
        """query_id, segment, block, chunk_id, score: the sum over the blocks' terms."""
        hits = blocks.select(*_PAIR, "w", F.inline("hits"))
        worth = F.col("w") * _weight(F.col("tf"), F.col("dl"), avgdl)
        return hits.groupBy(*_PAIR, "chunk_id").agg(F.sum(worth).alias("score"))

    def search(self, queries: DataFrame, k: int = bm25.TOP_K, store: Store | None = None) -> Found:
        """The k best chunks of every query, as ``bm25.search`` ranks them: query_id, rank, chunk_id, score."""
        store = store or Store.fresh(self.spark, "passages")
        asked = bm25.query_terms(queries)
        if not self.chunks:
            kind = queries.schema["query_id"].dataType.simpleString()
            none = self.spark.sql(f"SELECT CAST(NULL AS {kind}) AS query_id, 0 AS rank, CAST(NULL AS string) AS chunk_id, 0D AS score WHERE false")
            return Found(none, none.select("query_id", "chunk_id"))
        avgdl = self.tokens / self.chunks
        asked = store.write("asked", asked)
        wanted = asked.select("term").distinct()
        terms = store.write("terms", self._terms().join(wanted, "term", "left_semi"))
        w = F.col("qtf") * bm25._idf(F.lit(self.chunks), F.col("df"))
        most = F.col("w") * _weight(F.col("most_tf"), F.col("least_dl"), avgdl)
        asked = store.write("weighed", asked.join(terms, "term").withColumn("w", w).withColumn("most", most).select("query_id", "term", "w", "df", "most"))

        seeds = self._seeds(asked, store, avgdl)
        ranked = seeds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        beaten = ranked.where(F.col("place") == k).select("query_id", (F.col("score") - SLACK).alias("least"))

        cheap = Window.partitionBy("query_id").orderBy(F.col("most") / F.col("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
        # A query whose rarest terms have fewer than k chunks has no score to beat: no term is set aside.
        split = asked.join(beaten, "query_id", "left").withColumn("aside", F.coalesce(F.sum("most").over(cheap) < F.col("least"), F.lit(False)))
        split = store.write("split", split)
        rest = split.where("aside").groupBy("query_id").agg(F.sum("most").alias("rest"), F.max("least").alias("least"))

        part = self._sums(self._asked(split.where("NOT aside").select("query_id", "term", "w")), avgdl).join(rest, "query_id", "left")
        part = part.where(F.col("rest").isNull() | (F.col("score") + F.col("rest") >= F.col("least")))
        part = store.write("part", part)

        blocks = self._asked(split.where("aside").select("query_id", "term", "w"), part)
        bound = F.col("w") * _weight(F.col("most_tf"), F.col("least_dl"), avgdl)
        # At most BLOCK hits of each of a query's terms.
        bounded = blocks.groupBy(*_PAIR).agg(F.sum(bound).alias("bound"), F.collect_list(F.struct("w", "hits")).alias("others"))
        near = part.join(bounded, _PAIR, "left").where(
            F.col("least").isNull() | (F.col("score") + F.coalesce("bound", F.lit(0.0)) >= F.col("least"))
        )

        def worth(other: Column) -> Column:
            own = F.filter(other["hits"], lambda hit: hit["chunk_id"] == F.col("chunk_id"))
            return F.transform(own, lambda hit: other["w"] * _weight(hit["tf"], hit["dl"], avgdl))

        more = F.aggregate(F.flatten(F.transform("others", worth)), F.lit(0.0), lambda total, one: total + one)
        scores = near.select("query_id", "chunk_id", (F.col("score") + F.coalesce(more, F.lit(0.0))).alias("score"))
        scores = store.write("scores", scores.where("score > 0"))
        scored = scores.select("query_id", "chunk_id").union(seeds.select("query_id", "chunk_id")).distinct()
        return Found(bm25._best(scores, k).select("query_id", "rank", "chunk_id", "score"), scored)

    def _seeds(self, asked: DataFrame, store: Store, avgdl: float) -> DataFrame:
        """Full scores of the chunks that are best by the query's rarest terms."""
        rare = Window.partitionBy("query_id").orderBy("df", "term")
        earlier = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rarest = asked.withColumn("earlier", earlier).where(F.col("earlier") < SEED_POSTINGS)
        sums = self._sums(self._asked(rarest.select("query_id", "term", "w")), avgdl)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        first = sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SEED_CHUNKS)
        first = store.write("seeds", first.select(*_PAIR, "chunk_id"))
        whole = self._sums(self._asked(asked.select("query_id", "term", "w"), first), avgdl)
        return store.write("seed_scores", whole.join(first, [*_PAIR, "chunk_id"], "left_semi").select("query_id", "chunk_id", "score"))
