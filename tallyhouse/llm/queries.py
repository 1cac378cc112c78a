"""The operators on the given tables, with production parameters: queries by name."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    bpe,
    embedding_dedup,
    license_scan,
    merkle,
    mixing,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    spelling,
    token_counts,
    token_files,
    warc,
)
from tallyhouse.sources.store import Store

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
COSINE = 0.98
SHINGLE_WORDS, MOST_BITS = 4, 4
END_ID = 2

#: The edits that ``op1_token_counts`` follows: personal data is replaced by these marks.
_MAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"\+?[0-9][0-9() -]{6,}[0-9]")


def personal_data_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask e-mail addresses and long numbers, last one first, so positions hold."""
    found = [(*m.span(), "<EMAIL>") for m in _MAIL.finditer(text)] if "@" in text else []
    for m in _NUMBER.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b, _ in found):
            found.append((*m.span(), "<NUMBER>"))
    return sorted(found, reverse=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), VOCABULARY, personal_data_edits)


def token_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of documents."""
    return bpe.encode(docs, VOCABULARY, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"), COSINE, Store.fresh(spark, "op3"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, folder, "labels"), Store.fresh(spark, "op4")))


def span_string(kinds: tuple[str, ...]) -> Column:
    """The spans of the kinds as kind:start:end, joined by commas."""
    some = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    spans = secret_scan.scan(table(spark, folder, "documents"))
    base = secret_scan.KINDS[:3]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(span_string(base), 256).alias("base_sha256"),
        span_string(secret_scan.KINDS).alias("spans"),
    )


def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    near = simhash.near_texts(docs, SHINGLE_WORDS, MOST_BITS, Store.fresh(spark, "op6"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan(table(spark, folder, "documents"), Store.fresh(spark, "op7"))
    return plan.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("positions")).alias("taken"),
        F.get("positions", F.lit(0)).alias("first_position"),
        F.get("positions", F.lit(1)).alias("second_position"),
    ).orderBy("first_position", "doc_id")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    shards = Store.fresh(spark, "op8").path("shards")
    token_files.write_shards(table(spark, folder, "documents"), shards, VOCABULARY, END_ID)
    return token_files.read_checksums(spark, shards)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, folder, "documents"), Store.fresh(spark, "op10"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    archive = warc.write_archive(pages, Store.fresh(spark, "op11"))
    return warc.captures(archive, pages.select("url", "page_id")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def lower_ascii(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's proof, folded with its leaf, or with that of a text put in lower case for every fifth by checksum."""
    docs = table(spark, folder, "documents")
    honest = [F.col(name) for name in merkle.FIELDS]
    changed = merkle.leaf_hash(*honest[:-1], lower_ascii(F.col("text")))
    every_fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(every_fifth, changed).otherwise(merkle.leaf_hash(*honest))
    proofs = merkle.write_manifest(docs, Store.fresh(spark, "op12"), claim=claim).proofs()
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_hash(F.col("way")).alias("proof_sha256"),
        merkle.folded(F.col("claim"), F.col("way")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents")), Store.fresh(spark, "op13"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            op1_token_counts,
            op2_bpe,
            op3_embedding_dedup,
            op4_quality_classifier,
            op5_secret_scan,
            op6_simhash_dedup,
            op7_mixing,
            op8_token_files,
            op9_license_scan,
            op10_quality_rules,
            op11_warc,
            op12_merkle,
            op13_spelling,
            pipeline,
        )
    }
