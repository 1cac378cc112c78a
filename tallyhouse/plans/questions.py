"""Saved business questions: sort questions into intents and attach the policy they touch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import redact
from tallyhouse.operators import bm25
from tallyhouse.operators.chunking import chunk_markdown
from tallyhouse.plans import metrics
from tallyhouse.plans.marts import Marts
from tallyhouse.sources.audit import AuditLog
from tallyhouse.sources.files import read_markdown
from tallyhouse.sources.store import Store

PASSAGE_CHARS = 500
# Parts in which questions of one text are joined with their passage.
SALTS = 8


@dataclass(frozen=True)
class Intent:
    name: str
    keywords: tuple[str, ...]
    heading: str
    table: str
    report: Callable[[DataFrame], DataFrame]
    policy: str  # what to look up in the policies


# Keywords, headings and policy searches, in the order they are tried.
INTENTS = (
    Intent(
        "risk",
        ("risk", "churn", "at-risk", "at risk"),
        "Accounts most at risk, by revenue:",
        "customer_360",
        metrics.top_at_risk,
        "high-risk accounts health score service review call",
    ),
    Intent(
        "debt",
        ("overdue", "debt", "unpaid", "owe"),
        "Customers with invoices more than 45 days overdue:",
        "customer_360",
        metrics.top_debtors,
        "credit control overdue",
    ),
    Intent(
        "service",
        ("sla", "breach", "ticket", "support"),
        "Ticket categories by SLA breach rate:",
        "fact_ticket",
        metrics.breach_rate_by_category,
        "SLA service credit",
    ),
    Intent(
        "revenue",
        ("revenue", "mrr", "product", "sales"),
        "Monthly recurring revenue by product line (latest month):",
        "fact_invoice",
        metrics.mrr_by_product,
        "product catalogue",
    ),
    Intent(
        "portfolio",
        ("manager", "portfolio"),
        "Account manager portfolios:",
        "customer_360",
        metrics.account_manager_portfolio,
        "service review",
    ),
)


def _asks(question: Column, intent: Intent) -> Column:
    """Any keyword anywhere in the question."""
    return reduce(Column.__or__, (F.contains(question, F.lit(word)) for word in intent.keywords))


def _first_match(question: Column, result: Callable[[Intent], str]) -> Column:
    """The result of the first intent the question asks for, else NULL."""
    lowered = F.lower(question)
    return F.coalesce(*(F.when(_asks(lowered, i), F.lit(result(i))) for i in INTENTS))


def classify(questions: DataFrame) -> DataFrame:
    """Questions (``question_id, question``), redacted, with their intent and search text.

    A question without an intent is its own search text.
    """
    question = F.col("question")
    policy = _first_match(question, lambda i: i.policy)
    return questions.select("question_id", redact(question).alias("question")).select(
        "question_id",
        "question",
        _first_match(question, lambda i: i.name).alias("intent"),
        F.coalesce(policy, question).alias("search"),
    )


def with_policy(classified: DataFrame, chunks: DataFrame, store: Store | None = None) -> DataFrame:
    """Attach the start of the best policy passage to each question.

    Each distinct search text is looked up once, however many questions share it.
    """
    asked = classified.withColumn("search_id", F.md5("search"))
    queries = asked.select(F.col("search_id").alias("query_id"), F.col("search").alias("query")).distinct()
    best = bm25.search(chunks, queries, k=1, store=store, more_queries_than_chunks=True)
    passages = chunks.select(
        "chunk_id",
        "title",
        F.col("heading").alias("section"),
        F.left("text", F.lit(PASSAGE_CHARS)).alias("passage"),
    )
    found = best.select(F.col("query_id").alias("search_id"), "chunk_id").join(passages, "chunk_id")
    columns = ["question_id", "intent", "chunk_id", "title", "section", "passage"]
    if store is None:  # a few questions at a prompt
        return asked.join(found, "search_id", "left").select(*columns)
    found = store.write("policy_passages", found)
    # Most questions share the few searches of the intents: those passages go to the questions. Others' own searches
    # are joined, in parts, for one question may be asked by many.
    shared = [hashlib.md5(intent.policy.encode()).hexdigest() for intent in INTENTS]
    of_intents = F.broadcast(found.filter(F.col("search_id").isin(*shared)))  # a row for each intent at most
    answered = asked.filter(F.col("search_id").isin(*shared)).join(of_intents, "search_id", "left")
    own = asked.filter(~F.coalesce(F.col("search_id").isin(*shared), F.lit(False)))
    own = own.withColumn("salt", F.pmod(F.xxhash64("question_id"), F.lit(SALTS)))
    parts = found.filter(~F.col("search_id").isin(*shared)).withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    others = own.join(parts, ["search_id", "salt"], "left").drop("salt")
    return answered.unionByName(others).select(*columns)


def knowledge_base(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of a folder of Markdown policies, ready to search."""
    position = F.lpad(F.col("position").cast("string"), 6, "0")
    return chunk_markdown(read_markdown(spark, folder)).select(
        F.concat("doc", F.lit(".md#"), position).alias("chunk_id"), "title", "heading", "text"
    )


@dataclass(frozen=True)
class Answer:
    """What the data and the policies say to one question. Both frames are still lazy."""

    heading: str | None
    report: DataFrame | None
    policy: DataFrame


def answer(question: str, marts: Marts, chunks: DataFrame, audit: AuditLog | None = None) -> Answer:
    """The saved report a question asks for, if any, and the best policy passage.

    The audit gets the question, the saved report, and what was looked up and found, in one write.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame([("1", question)], "question_id string, question string")
    sorted_out = classify(asked)
    _, redacted, name, _ = sorted_out.first()
    policy = with_policy(sorted_out, chunks).select("chunk_id", "title", "section", "passage")
    intent = next((i for i in INTENTS if i.name == name), None)
    if audit:
        found = [f"{r.title} / {r.section}" for r in policy.filter("chunk_id IS NOT NULL").collect()]
        events = [("question", {"question": redacted, "intent": name or "none"})]
        if intent:
            events.append(("sql_run", {"purpose": intent.heading, "table": intent.table}))
        events.append(("kb_search", {"query": intent.policy if intent else redacted, "found": found}))
        audit.record_many("questions", events)
    if intent is None:
        return Answer(None, None, policy)
    return Answer(intent.heading, intent.report(marts.table(intent.table)), policy)
