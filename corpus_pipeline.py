"""From documents to training tokens: quality, near-duplicates, secrets, mixing, encoding.

Each stage is written as Parquet in the shared folder and read again, so a lost executor costs a part of one stage.
All stages but the last return the columns of documents; the mixing stage repeats a document that it takes twice and puts
the rows in training order. The last returns a row of token digests for each row that it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import mixing, quality_classifier, secret_scan, simhash
from tallyhouse.llm.queries import MOST_BITS, SHINGLE_WORDS, table, token_digests
from tallyhouse.sources.store import Store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; the classifier learns from the labels and from all these documents."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), Store.fresh(spark, "pipeline-quality"))
    return quality_classifier.good_documents(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, SHINGLE_WORDS, MOST_BITS, Store.fresh(spark, "pipeline-simhash"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mixed(docs, Store.fresh(spark, "pipeline-mixing"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the tokens of each row, and digest of the text decoded from them."""
    return token_digests(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", one_of_each),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
    ("bpe encoding and decoding", tokens),
]

#: No SQL: classifier, near-duplicates, spans and byte pairs are not expressible; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, store = table(spark, sf_dir, "documents"), Store.fresh(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        docs = store.write(f"stage_{at}", stage(spark, docs, sf_dir))
    return docs
