"""Chunking and BM25 against plain Python on small texts."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks import queries as registered
from tallyhouse.operators import bm25
from tallyhouse.operators.chunking import chunk_markdown
from tallyhouse.plans import questions
from tallyhouse.sources import files
from tallyhouse.sources.audit import AuditLog
from tallyhouse.sources.store import Store
from tests.test_functions import python_tokens

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

POLICIES = {
    "refunds": "# Refund Policy\n\n## Faulty goods\nFaulty goods are refunded in full.\n\n"
    "## Late delivery\nLate parcels earn a credit of 5% for every repeated delay.\n",
    "visits": "# Site Visits\nHow engineers book.\n## Booking\nBook visits by phone.\n## Empty\n\n   \n",
    "plain": "Only one paragraph, without headings.\r\nSecond line.",
}


@pytest.fixture(scope="module")
def policies(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("policies")
    for name, content in POLICIES.items():
        (folder / f"{name}.md").write_bytes(content.encode())
    (folder / "ignored.txt").write_text("# No\n## No\nno")
    return questions.knowledge_base(spark, str(folder))


def test_sections_of_a_folder(policies):
    got = [tuple(r) for r in policies.orderBy("chunk_id").collect()]
    assert got == [
        ("plain.md#000000", "plain", "plain", "Only one paragraph, without headings.\nSecond line."),
        ("refunds.md#000001", "Refund Policy", "Faulty goods", "Faulty goods are refunded in full."),
        (
            "refunds.md#000002",
            "Refund Policy",
            "Late delivery",
            "Late parcels earn a credit of 5% for every repeated delay.",
        ),
        ("visits.md#000000", "Site Visits", "Site Visits", "How engineers book."),
        ("visits.md#000001", "Site Visits", "Booking", "Book visits by phone."),
    ]


WRITTEN = {
    # document: (its text, its sections as title, heading, text)
    "a": ("# T\nintro\n## one\nfirst\nsecond\n## two\nthird", [
        ("T", "T", "intro"), ("T", "one", "first\nsecond"), ("T", "two", "third")]),
    "b": ("no heading\n\nat all  ", [("b", "b", "no heading\n\nat all")]),
    "c": ("## only\n\n   \n## kept\n### deeper\n#none", [("c", "kept", "### deeper\n#none")]),
    "d": ("# A\nx\n## s\n# B\ny", [("A", "A", "x"), ("B", "B", "y")]),
    "e": ("", []),
    "f": ("# Title only", []),
    "g": ("#  spaced \r\nx\r\n##  two  \ry", [("spaced", "spaced", "x"), ("spaced", "two", "y")]),
}


def test_a_folder_is_listed_once_and_small_files_share_a_task(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"doc {i}.md").write_text(f"# Title {i}\n## One\nbody {i}")
    for inner in ("notes", "lang=en"):  # neither read nor taken for partitions
        (tmp_path / inner).mkdir()
        (tmp_path / inner / "deep.md").write_text("deep")
    (tmp_path / "other.txt").write_text("other")
    monkeypatch.setattr(files, "TASK_BYTES", 1000)
    read = files.read_markdown(spark, str(tmp_path))
    assert sorted(read.collect()) == sorted((f"doc {i}", f"# Title {i}\n## One\nbody {i}") for i in range(300))
    assert read.inputFiles() and read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    scan = read._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    assert scan.rootPaths().length() == 1
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.read_markdown(spark, str(tmp_path / "notes" / "none"))


ODD_FILES = {
    "a.md": b"# T\nx", "b c.md": b"space", "p+q.md": b"plus", "50%20.md": b"percent", "\u00e9t\u00e9.md": "caf\u00e9".encode(), "x.md.md": b"twice",
    "bad.md": b"ok \xff end", "mark.md": b"\xef\xbb\xbfx", "lines.md": b"a\r\nb\x00c", "empty.md": b"", "_a=1.md": b"kept",
    "_left.md": b"out", ".left.md": b"out", "UPPER.MD": b"out", "other.txt": b"out",
}


def test_a_large_folder_is_read_by_names_that_the_driver_does_not_hold(spark, tmp_path, monkeypatch):
    folder = tmp_path / "notes & \u00e9%20"
    (folder / "deep.md").mkdir(parents=True)
    (folder / "deep.md" / "in.md").write_text("deep")
    for name, content in ODD_FILES.items():
        (folder / name).write_bytes(content)

    def rows(frame):
        return sorted(map(tuple, frame.select("doc", F.hex("text")).collect()))

    few = files.read_markdown(spark, str(folder))
    monkeypatch.setattr(files, "LISTED_FILES", 3)
    monkeypatch.setattr(files, "_NAMES", 4)
    monkeypatch.setattr(files, "_TEXT_BYTES", 8)
    many = files.read_markdown(spark, str(folder))
    assert rows(many) == rows(few) and len(rows(many)) == 10
    assert few.inputFiles() and not many.inputFiles()
    assert many.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows(files.read_markdown(spark, f"{tmp_path}/notes*")) == rows(few)
    (folder / "none").mkdir()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.read_markdown(spark, str(folder / "none"))


def test_sections_of_written_documents(spark):
    frame = spark.createDataFrame([(d, t) for d, (t, _) in WRITTEN.items()], "doc string, text string")
    got = chunk_markdown(frame).orderBy("doc", "position").select("doc", "title", "heading", "text")
    assert [tuple(r) for r in got.collect()] == [(d, *s) for d, (_, found) in WRITTEN.items() for s in found]


LINES = st.sampled_from(["# A", "## one", "## two", "### deep", "text", "more words", "", "#none"])


@FEW
@given(st.lists(st.lists(LINES, max_size=14), min_size=1, max_size=25))
def test_every_line_of_text_is_in_one_section(spark, documents):
    """Sections in order hold all lines but headings and blanks, each once and in its place."""
    texts = [(f"d{i:02}", "\n".join(lines)) for i, lines in enumerate(documents)]
    frame = spark.createDataFrame(texts, "doc string, text string")
    found = {}
    for row in chunk_markdown(frame).orderBy("doc", "position").collect():
        assert row.text == row.text.strip() != ""
        assert row.heading in (row.title, "one", "two") and row.title in ("A", row.doc)
        found.setdefault(row.doc, []).extend(line for line in row.text.split("\n") if line)
    want = {
        doc: [line for line in text.split("\n") if line and not line.startswith(("# ", "## "))]
        for doc, text in texts
    }
    assert found == {doc: lines for doc, lines in want.items() if lines}


def plain_bm25(chunks, query, k):
    docs = [Counter(python_tokens(f"{h} {h} {t}")) for _, h, t in chunks]
    n, mean = len(docs), sum(d.total() for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d)
    scored = []
    for (chunk_id, _, _), d in zip(chunks, docs):
        score = 0.0
        for t in python_tokens(query):
            if d[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                score += idf * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * d.total() / mean))
        if score > 0:
            scored.append((-round(score, 6), chunk_id, score))
    return [(c, s) for _, c, s in sorted(scored)[:k]]


WORDS = st.lists(st.sampled_from("alpha beta betas gamma the ring rings £5 credit credits".split()), max_size=12)


@FEW
@given(
    st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=15),
    st.lists(WORDS, min_size=1, max_size=6),
    st.booleans(),
    st.booleans(),
)
def test_bm25_is_the_formula(spark, chunk_words, query_words, stored, many_queries):
    chunks = [(i, " ".join(h), " ".join(t)) for i, (h, t) in enumerate(chunk_words)]
    asked = [(i, " ".join(q)) for i, q in enumerate(query_words)]
    got = bm25.search(
        spark.createDataFrame(chunks, "chunk_id int, heading string, text string"),
        spark.createDataFrame(asked, "query_id int, query string"),
        k=3,
        store=Store.fresh(spark, "bm25") if stored else None,
        more_queries_than_chunks=many_queries,
    )
    found = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in got.collect()}
    want = {
        (i, rank): hit
        for i, q in asked
        for rank, hit in enumerate(plain_bm25(chunks, q, 3), 1)
    }
    assert found.keys() == want.keys()
    for key, (chunk_id, score) in want.items():
        assert found[key][0] == chunk_id and found[key][1] == pytest.approx(score)


@pytest.mark.parametrize("many_queries", [False, True])
def test_blocks_and_shuffle_joins_give_the_same(spark, small, monkeypatch, many_queries):
    chunks = spark.read.parquet(f"{small}/documents.parquet").selectExpr(
        "doc_id AS chunk_id", "source AS heading", "text"
    )
    asked = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query")

    def best(store):
        found = bm25.search(chunks, asked, store=store, more_queries_than_chunks=many_queries)
        return sorted(found.drop("score").collect())

    one_block = best(Store.fresh(spark, "one"))
    store = Store.fresh(spark, "many")
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 3000 if many_queries else 500)
    monkeypatch.setattr(bm25, "SALTS", 3)
    blocks = best(store)
    written = store.read("bm25_postings" if many_queries else "bm25_queries")
    assert written.count() > 2 * bm25.BROADCAST_ROWS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = best(None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert one_block == blocks == shuffled and one_block


@pytest.mark.parametrize("many_queries", [False, True])
def test_tasks_follow_the_matches(spark, monkeypatch, many_queries):
    """A task holds the pairs its rows add up to, so more matches get more tasks."""
    chunks = spark.createDataFrame([(i, "head", f"common word{i % 7} word{i % 5}") for i in range(200)], "chunk_id int, heading string, text string")
    asked = spark.createDataFrame([(i, f"common word{i % 5}") for i in range(40)], "query_id int, query string")
    search = lambda: bm25.search(chunks, asked, store=Store.fresh(spark, "bm25"), more_queries_than_chunks=many_queries)
    rows = lambda found: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in found.collect())
    whole = rows(search())
    monkeypatch.setattr(bm25, "TASK_MATCHES", 100)
    dealt, repartition = [], type(chunks).repartition
    monkeypatch.setattr(type(chunks), "repartition", lambda self, n, *by: (dealt.append((n, *by)), repartition(self, n, *by))[1])
    assert rows(search()) == whole
    matches = sum(len({*c.split()} & {*q.split()}) for _, _, c in chunks.collect() for _, q in asked.collect())
    assert dealt == [(math.ceil(matches / 100), "query_id" if many_queries else "chunk_id")]


def test_term_counts_of_a_hot_term(spark):
    text = "alpha " * 200_000 + "beta"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "the of")], "k int, v string")
    got = bm25.term_frequencies(rows, "k", F.col("v")).collect()
    assert sorted(map(tuple, got)) == [(1, "alpha", 200_000), (1, "beta", 1)]


def test_best_policy(spark, policies):
    asked = spark.createDataFrame([(1, "credit for repeated delays")], "query_id int, query string")
    best = bm25.search(policies, asked, k=1).join(policies, "chunk_id").first()
    assert (best.title, best.heading) == ("Refund Policy", "Late delivery")


def test_questions_by_intent(spark, policies):
    asked = [
        ("1", "Which accounts are AT RISK?"),
        ("2", "who owes us money? mail ann@x.org"),
        ("3", "churn and unpaid"),
        ("4", "Support tickets"),
        ("5", "sales by manager"),
        ("6", "Who books engineers on 07700 900123 ?"),
        ("7", "portfolio"),
    ]
    frame = spark.createDataFrame(asked, "question_id string, question string")
    got = {r.question_id: r for r in questions.classify(frame).collect()}
    intents = [got[i].intent for i, _ in asked]
    assert intents == ["risk", "debt", "risk", "service", "revenue", None, "portfolio"]
    shown = dict(asked) | {"2": "who owes us money? mail [EMAIL]", "6": "Who books engineers on [PHONE]?"}
    assert {i: got[i].question for i, _ in asked} == shown
    assert got["6"].search == shown["6"]


def test_answer_to_one_question(spark, small, policies, tmp_path):
    marts, audit = registered.marts(spark, small), AuditLog(spark, str(tmp_path / "audit"))
    reply = questions.answer("Who owes us money? Tell ann@x.org", marts, policies, audit)
    assert [(r.event, r.detail) for r in audit.entries().orderBy("seq").collect()] == [
        ("question", {"question": "Who owes us money? Tell [EMAIL]", "intent": "debt"}),
        ("sql_run", {"purpose": "Customers with invoices more than 45 days overdue:", "table": "customer_360"}),
        ("kb_search", {"query": "credit control overdue", "found": '["Refund Policy / Late delivery"]'}),
    ]
    assert reply.heading == "Customers with invoices more than 45 days overdue:"
    assert 0 < reply.report.count() <= 10
    passage = reply.policy.first()  # "credit" is all it shares
    assert (passage.title, passage.section) == ("Refund Policy", "Late delivery")
    other = questions.answer("May engineers visit?", marts, policies)
    assert other.report is None and other.policy.first().section in ("Booking", "Site Visits")


def test_many_questions_with_one_text(spark, policies):
    asked = spark.range(3000).select(
        F.col("id").cast("string").alias("question_id"),
        F.when(F.col("id") % 3 == 0, F.lit("late parcels"))
        .otherwise(F.concat(F.lit("visits "), F.col("id").cast("string")))
        .alias("question"),
    )
    got = questions.with_policy(questions.classify(asked), policies, Store.fresh(spark, "many"))
    counts = {r.section: r["count"] for r in got.groupBy("section").count().collect()}
    assert counts.pop("Late delivery") == 1000 and sum(counts.values()) == 2000


def test_all_questions_of_one_intent(spark):
    """Questions that share a search, by an intent or by their own text, all get its passage; none is a hot key."""
    from tallyhouse.plans import questions

    chunks = spark.createDataFrame(
        [(1, "Credit", "Credit hold", "overdue debt beyond terms credit hold"), (2, "Care", "Opening hours", "we open at nine on weekdays")],
        "chunk_id long, title string, heading string, text string",
    )
    asked = spark.range(4000).selectExpr("CAST(id AS string) AS question_id", "IF(id % 4 = 0, 'When do you open on weekdays?', 'Who owes us overdue money?') AS question")
    sorted_out = questions.classify(asked)
    found = questions.with_policy(sorted_out, chunks, Store.fresh(spark, "policy"))
    assert {(r.intent, r.section): r["count"] for r in found.groupBy("intent", "section").count().collect()} == {
        (None, "Opening hours"): 1000,
        (sorted_out.where("question_id = '1'").first().intent, "Credit hold"): 3000,
    }
    alone = questions.with_policy(sorted_out, chunks).select(*found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan and "broadcast" in plan
