"""BM25 passage search for many queries at once.

Chunks have ``chunk_id, heading, text`` and queries ``query_id, query``. Term counts are worked
out inside each row, so text never moves; what moves is term statistics, the postings of terms
some query asks for, and at the end at most k rows per query and task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.text import search_tokens
from tallyhouse.sources.store import Store

K1, B = 1.5, 0.75
TOP_K = 3
# Ranks compare rounded scores: equal passages must tie whatever order their terms were added in.
RANK_DECIMALS = 6
# So many short rows (an id, a term and a number) are broadcast at a time.
BROADCAST_ROWS = 2_000_000
# Postings that meet a query's term in one task; it holds the pairs they add up to.
TASK_MATCHES = 2_000_000
_ALL = ""  # the pseudo-term that counts every chunk once
# Rows of one term are joined in so many places, so a term that every chunk holds is no hot key.
SALTS = 64


def index_text() -> Column:
    """A heading counts twice."""
    return F.concat_ws(" ", "heading", "heading", "text")


def _runs(tokens: str) -> Column:
    """Where each new term starts in a sorted token array."""
    token = F.col(tokens)
    starts = F.transform(token, lambda t, i: F.when((i == 0) | (t != F.get(token, i - 1)), i))
    return F.filter(starts, lambda i: i.isNotNull())


def _term_counts(tokens: str, runs: str) -> Column:
    token, run = F.col(tokens), F.col(runs)

    def count(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get(run, n + 1), F.size(token))
        return F.struct(F.get(token, start).alias("term"), (end - start).alias("tf"))

    return F.transform(run, count)


def term_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Per row: its key, its token count ``dl`` and an array of (term, tf). Linear after one sort."""
    return (
        rows.select(key, F.sort_array(search_tokens(text)).alias("tokens"))
        .select(key, "tokens", _runs("tokens").alias("runs"))
        .select(key, F.size("tokens").alias("dl"), _term_counts("tokens", "runs").alias("counts"))
    )


def _listed(rows: DataFrame, key: list[str], items: Column, field: str) -> DataFrame:
    """One row per array item.

    The outer form, because the plain one makes the optimiser test the array's size further down,
    where it would have to work the array out again for that test, and again for each token.
    """
    return rows.select(*key, F.inline_outer(items)).filter(F.col(field).isNotNull())


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl, term, tf."""
    counts = term_counts(chunks, "chunk_id", index_text())
    return _listed(counts, ["chunk_id", "dl"], F.col("counts"), "term")


def term_frequencies(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf."""
    return _listed(term_counts(rows, key, text), [key], F.col("counts"), "term")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf; a term asked for twice counts twice."""
    return term_frequencies(queries, "query_id", F.col("query")).withColumnRenamed("tf", "qtf")


def _join_terms(rows: DataFrame, key: str, terms: DataFrame, how: str) -> DataFrame:
    """Rows joined with a table of terms, one row each, which is repeated for every salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    each = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, ["term", "salt"], how).drop("salt")


def _counted(chunks: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (all, or those of a vocabulary's terms) and a pseudo-term once for every chunk.

    With that, this one pass over the text is enough for every statistic and for the scores.
    """
    counts = term_counts(chunks, "chunk_id", index_text())
    everything = F.struct(F.lit(_ALL).alias("term"), F.lit(1).alias("tf"))
    listed = _listed(counts, ["chunk_id", "dl"], F.array_append("counts", everything), "term")
    if vocabulary is None:
        return listed
    pseudo = vocabulary.sparkSession.range(1).select(F.lit(_ALL).alias("term"))
    return _join_terms(listed, "chunk_id", vocabulary.union(pseudo), "left_semi")


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _stats(frequency: DataFrame) -> DataFrame:
    """term, df, idf, avgdl for every real term."""
    everything = frequency.filter(F.col("term") == _ALL)
    n = everything.select("df").scalar()
    avgdl = everything.select(F.col("tokens") / F.col("df")).scalar()
    return frequency.filter(F.col("term") != _ALL).select(
        "term", "df", _idf(n, F.col("df")).alias("idf"), avgdl.alias("avgdl")
    )


def _frequency(counted: DataFrame) -> DataFrame:
    """term, df, tokens of the chunks it is in; hot terms are added up before the shuffle."""
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("tokens"))


def term_stats(chunks: DataFrame, store: Store | None = None) -> DataFrame:
    """Document frequency and IDF of every term, and the mean chunk length.

    With a store the counts are written, so that the totals do not cost a second pass.
    """
    frequency = _frequency(_counted(chunks))
    return _stats(store.write("bm25_terms", frequency) if store else frequency)


def _broadcast_blocks(written: DataFrame, side: DataFrame, key: str) -> list[DataFrame]:
    """One side of the join in parts small enough to broadcast, each with whole keys.

    ``written`` is the table the side is made from, row by row, and gives its size.
    """
    blocks = max(1, math.ceil(written.count() / BROADCAST_ROWS))
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return [F.broadcast(side.filter(block == i) if blocks > 1 else side) for i in range(blocks)]


def _spread(rows: DataFrame, key: str, asked: DataFrame, frequency: DataFrame) -> DataFrame:
    """Rows dealt by key to as many tasks as their matches need, by the counts in ``frequency``, or as there are cores."""
    matches = _join_terms(asked, "query_id", frequency, "inner").agg(F.sum("df")).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, math.ceil(matches / TASK_MATCHES)), key)


def _scores(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """Score of every query and chunk that share a term; ``asked`` brings what is known of its terms."""
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return (
        counted.join(asked, "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(F.col("qtf") * weight).alias("score"))
        .filter(F.col("score") > 0)
    )


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", RANK_DECIMALS).desc(), F.col("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    store: Store | None = None,
    more_queries_than_chunks: bool = False,
) -> DataFrame:
    """The k best chunks of every query: query_id, rank, chunk_id, score.

    With a store, text is read once: the postings of the terms asked for are written, and
    statistics and scores come from them. IDF is attached to the terms of the queries. The more
    numerous side is spread by its id, over tasks by the counted matches; the other is broadcast to it in blocks, one after the other,
    each block's best written before the next. All that adds to one score is then in one place, so
    pairs are never shuffled, only the k best of each query and task. Joins by term are salted.
    """
    asked = query_terms(queries)
    if store:
        asked = store.write("bm25_queries", asked)
    counted = _counted(chunks, asked.select("term").distinct())
    if store:
        counted = store.write("bm25_postings", counted)
    frequency = _frequency(counted)
    if store:
        frequency = store.write("bm25_terms", frequency)
    stats = _stats(frequency)
    weighed = _join_terms(asked, "query_id", stats.drop("df"), "inner")

    if more_queries_than_chunks:
        wide = _spread(weighed, "query_id", asked, frequency) if store else weighed.repartition("query_id")
        blocks = _broadcast_blocks(counted, counted, "chunk_id") if store else [counted]
        parts = [_best(_scores(block, wide), k) for block in blocks]
    else:
        wide = _spread(counted, "chunk_id", asked, frequency) if store else counted.repartition("chunk_id")
        blocks = _broadcast_blocks(asked, weighed, "query_id") if store else [weighed]
        parts = [_best(_scores(wide, block), k) for block in blocks]
    if len(parts) == 1:
        return parts[0].select("query_id", "rank", "chunk_id", "score")
    parts = [store.write(f"bm25_best_{i}", part) for i, part in enumerate(parts)]
    return _best(reduce(DataFrame.union, parts), k).select("query_id", "rank", "chunk_id", "score")
