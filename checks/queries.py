"""Every registered query by name. Each takes the session and the folder of the test tables.

The marts of a folder are written once per Spark application, in the shared folder, and the
queries above them read those tables, as users of the marts do.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.extracts import deliver_files, deliver_markdown, extracts, spread_table, table, user_questions
from tallyhouse.functions import parsing
from tallyhouse.functions.keys import canonical_key
from tallyhouse.functions.text import raw_tokens, redact, search_tokens, title_case
from tallyhouse.operators import actions, bm25, rollups
from tallyhouse.operators.chunking import chunk_markdown
from tallyhouse.operators.governed import GovernedSession, as_records
from tallyhouse.operators.ingest import IngestResult, ingest
from tallyhouse.operators.passage_index import PassageIndex
from tallyhouse.operators.quarantine import Loaded, Quarantine
from tallyhouse.plans import marts as mart_plans
from tallyhouse.plans import metrics, policies, questions
from tallyhouse.plans.marts import Marts
from tallyhouse.plans.monthly import FACTS, MonthlyMarts
from tallyhouse.sources.audit import AuditLog, audit_rows
from tallyhouse.sources.config import load_bands, load_rules, load_sources
from tallyhouse.sources.files import read_markdown, read_sources
from tallyhouse.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]

RUN_AT = datetime(2024, 2, 1, 9, 0, 0)
RUN_AGAIN_AT = datetime(2024, 2, 2, 9, 0, 0)

_QUERIES: dict[str, Query] = {}
_written: dict[tuple[str, str, bool], IngestResult | Marts] = {}
_indexed: dict[tuple[str, str], PassageIndex] = {}
_read_from_files: dict[tuple[str, str], IngestResult] = {}
_quarantined: dict[tuple[str, str], tuple[Quarantine, Loaded, Loaded]] = {}
_kept_by_month: dict[tuple[str, str], MonthlyMarts] = {}
_lock = threading.Lock()


def _query(function: Query) -> Query:
    _QUERIES[function.__name__.removesuffix("_query_")] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _ingested(spark: SparkSession, folder: str, dirty: bool) -> tuple[IngestResult, Store]:
    store = Store.fresh(spark, "dirty" if dirty else "clean")
    return ingest(extracts(spark, folder, dirty), load_sources(), store), store


def dirty_ingest(spark: SparkSession, folder: str) -> IngestResult:
    """The extracts with planted faults, ingested."""
    key = (spark.sparkContext.applicationId, folder, True)
    with _lock:
        if key not in _written:
            _written[key] = _ingested(spark, folder, True)[0]
        return _written[key]


def marts(spark: SparkSession, folder: str) -> Marts:
    """The marts of the extracts without planted faults."""
    key = (spark.sparkContext.applicationId, folder, False)
    with _lock:
        if key not in _written:
            _written[key] = Marts(*_ingested(spark, folder, False)).build()
        return _written[key]


def _mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return marts(spark, folder).table(name)


def plain(frame: DataFrame, may_lack: tuple[str, ...] = ()) -> DataFrame:
    """Results in a form that every engine and client shows alike: dates and times as text, doubles
    with four decimals, and whole numbers that may be missing as doubles."""

    def shown(name: str, kind: str):
        column = F.col(name)
        if name in may_lack:
            return column.cast("double").alias(name)
        if kind == "double":
            return F.round(column, 4).alias(name)
        if kind in ("date", "timestamp_ntz", "timestamp"):
            return column.cast("string").alias(name)
        return column

    return frame.select(*(shown(name, kind) for name, kind in frame.dtypes))


MAY_LACK = ("csat_score", "days_to_pay", "days_outstanding")


# --- Column functions over raw-style text -----------------------------------


@_query
def canonical_key_query_(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all four systems, delivered with and without faults."""
    mapping, raw = load_sources(), extracts(spark, folder, dirty=True)
    parts = []
    for name, source in mapping.items():
        field = source["key"]["field"]
        text = F.col(f"`{field}`")
        counted = raw[name].groupBy(text.alias("raw_key")).agg(F.count("*").alias("records"))
        parts.append(
            counted.select(
                F.lit(name).alias("source"),
                "raw_key",
                canonical_key(F.col("raw_key"), source["key"]["pattern"]).alias("customer_id"),
                "records",
            )
        )
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@_query
def parse_currency(spark: SparkSession, folder: str) -> DataFrame:
    raw = extracts(spark, folder, dirty=True)["billing"]
    amount = parsing.parse(F.col("net_amount"), {"type": "currency"})
    return raw.select("invoice_no", "net_amount", amount.alias("amount_gbp"))


@_query
def parse_types(spark: SparkSession, folder: str) -> DataFrame:
    """Dates, times and numbers, some of them spoilt on purpose."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    bad_day = F.when(key % 7 == 0, F.replace(day, F.lit("/"), F.lit("-"))).otherwise(day)
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    bad_moment = F.when(key % 11 == 0, F.concat(moment, F.lit("Z"))).otherwise(moment)
    number = (
        F.when(key % 13 == 0, F.lit("n/a"))
        .when(key % 13 == 1, F.lit(""))
        .when(key % 13 == 2, F.concat(F.lit(" "), key.cast("string"), F.lit(" ")))
        .when(key % 13 == 3, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 13 == 4, F.concat(key.cast("string"), F.lit(".5")))
        .otherwise(key.cast("string"))
    )
    raw = table(spark, folder, "orders").select(
        "o_orderkey", bad_day.alias("day"), bad_moment.alias("moment"), number.alias("number")
    )
    return plain(
        raw.select(
            "o_orderkey",
            parsing.parse(F.col("day"), {"type": "date", "format": "%d/%m/%Y"}).alias("as_date"),
            parsing.parse(
                F.col("moment"), {"type": "datetime", "format": "%Y-%m-%dT%H:%M:%S"}
            ).alias("as_datetime"),
            parsing.parse(F.col("number"), {"type": "int"}).alias("as_int"),
            parsing.parse(F.col("number"), {"type": "float"}).alias("as_float"),
        ),
        ("as_int",),
    )


@_query
def title_case_query_(spark: SparkSession, folder: str) -> DataFrame:
    """Shouted, hyphenated and padded names of parts and segments."""
    parts = table(spark, folder, "part")
    shouted = F.concat(F.lit("  "), F.upper("p_name"), F.lit("-"), F.lower("p_type"), F.lit("\t"))
    return parts.select("p_partkey", title_case(shouted).alias("title"))


# --- Ingest -----------------------------------------------------------------


def _register_ingest(entity: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        if not any(s["pii"] for s in load_sources().values() if s["entity"] == entity and "pii" in s):
            return plain(dirty_ingest(spark, folder).frame(entity), MAY_LACK)
        # Nothing is written, so columns with personal data are still there.
        lazy = ingest(extracts(spark, folder, dirty=True), load_sources())
        return plain(lazy.frame(entity), MAY_LACK)

    _QUERIES[f"ingest_{entity}"] = query


for _entity in ("customer", "invoice", "ticket", "usage"):
    _register_ingest(_entity)


@_query
def orphan_records(spark: SparkSession, folder: str) -> DataFrame:
    return plain(dirty_ingest(spark, folder).orphans("invoice"))


@_query
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_ingest(spark, folder).quality_report()


@_query
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_ingest(spark, folder).issue_counts()


@_query
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    rows = dirty_ingest(spark, folder).lineage()
    return rows.withColumn("pii_fields", F.array_join("pii_fields", ","))


def _from_files(spark: SparkSession, folder: str) -> IngestResult:
    """The faulty extracts delivered as CSV and JSON files in the shared folder, read from there and ingested."""
    key = (spark.sparkContext.applicationId, folder)
    with _lock:
        if key not in _read_from_files:
            place = Store.fresh(spark, "files")
            mapping = deliver_files(spark, extracts(spark, folder, dirty=True), place.path("extracts"), load_sources())
            _read_from_files[key] = ingest(read_sources(spark, place.path("extracts"), mapping), mapping, place)
        return _read_from_files[key]


@_query
def files_invoice(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices from CSV files."""
    return plain(_from_files(spark, folder).frame("invoice"), MAY_LACK)


@_query
def files_ticket(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets from JSON files, without personal data."""
    return plain(_from_files(spark, folder).frame("ticket"), MAY_LACK)


@_query
def files_quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return _from_files(spark, folder).quality_report()


@_query
def files_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Usage and tickets of unknown customers, by source."""
    found = _from_files(spark, folder)
    parts = [found.orphans(entity).select(F.lit(entity).alias("entity"), "customer_id") for entity in ("ticket", "usage", "invoice")]
    return reduce(DataFrame.unionByName, parts).groupBy("entity", "customer_id").agg(F.count("*").alias("records"))


def _replayed(spark: SparkSession, folder: str) -> tuple[Quarantine, Loaded, Loaded]:
    """Two runs: one that lacks every third customer, one that brings all customers and no facts."""
    key = (spark.sparkContext.applicationId, folder)
    with _lock:
        if key not in _quarantined:
            raw, mapping = extracts(spark, folder, dirty=True), load_sources()
            number = F.substring("Account ID", 3, 20).cast("bigint")
            held = Quarantine(spark, Store.fresh(spark, "quarantine").folder)
            first = held.ingest(raw | {"crm": raw["crm"].filter(number % 3 != 0)}, mapping, Store.fresh(spark, "quarantine-1"))
            later = {name: frame if name == "crm" else frame.limit(0) for name, frame in raw.items()}
            _quarantined[key] = held, first, held.ingest(later, mapping, Store.fresh(spark, "quarantine-2"))
        return _quarantined[key]


@_query
def quarantine_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices that either run loaded: all of known customers, each once."""
    _, first, second = _replayed(spark, folder)
    return plain(first.result.frame("invoice").unionByName(second.result.frame("invoice")), MAY_LACK)


@_query
def quarantine_held(spark: SparkSession, folder: str) -> DataFrame:
    """What is still held after both runs."""
    return _replayed(spark, folder)[0].held().groupBy("source", "reason").agg(F.count("*").alias("records"))


@_query
def quarantine_report(spark: SparkSession, folder: str) -> DataFrame:
    """What became of billing's records in the two runs."""
    _, first, second = _replayed(spark, folder)
    return first.report.unionByName(second.report).filter("source = 'billing'")


# --- Marts ------------------------------------------------------------------


def _register_mart(name: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain(_mart(spark, folder, name), MAY_LACK)

    _QUERIES[name] = query


for _name in ("dim_customer", "fact_invoice", "fact_ticket", "fact_usage"):
    _register_mart(_name)


@_query
def pii_minimised_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Every mart column and how many rows fill it; no column with personal data is there."""
    profiles = []
    for name in mart_plans.TABLES:
        frame = _mart(spark, folder, name)
        counts = frame.agg(*(F.count(c).alias(c) for c in frame.columns))
        profiles.append(
            counts.unpivot([], frame.columns, "column_name", "filled").select(
                F.lit(name).alias("table_name"), "column_name", "filled"
            )
        )
    return reduce(DataFrame.union, profiles)


@_query
def revenue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return plain(rollups.revenue(_mart(spark, folder, "fact_invoice")))


@_query
def overdue_debt_by_customer(spark: SparkSession, folder: str) -> DataFrame:
    return plain(rollups.overdue_debt(_mart(spark, folder, "fact_invoice")))


@_query
def ticket_rollup_90d(spark: SparkSession, folder: str) -> DataFrame:
    return plain(rollups.tickets_90d(_mart(spark, folder, "fact_ticket")))


@_query
def usage_trend(spark: SparkSession, folder: str) -> DataFrame:
    return plain(rollups.usage_trend(_mart(spark, folder, "fact_usage")))


@_query
def customer_360(spark: SparkSession, folder: str) -> DataFrame:
    """Built from the facts here, not read back, so the whole plan shows."""
    built = marts(spark, folder)
    tables = ("dim_customer", "fact_invoice", "fact_ticket", "fact_usage")
    wide = mart_plans.customer_360(*(built.table(n) for n in tables))
    return plain(wide).orderBy("health_score", "customer_id")


@_query
def health_score_components(spark: SparkSession, folder: str) -> DataFrame:
    return plain(mart_plans.health_components(_mart(spark, folder, "customer_360")))


# --- Marts by month ---------------------------------------------------------


def monthly(spark: SparkSession, folder: str) -> MonthlyMarts:
    """The marts in two deliveries: the first lacks the last months and has one old month wrong, the second sets that right."""
    key = (spark.sparkContext.applicationId, folder)
    with _lock:
        if key not in _kept_by_month:
            result, _ = _ingested(spark, folder, False)
            whole = {entity: result.without_pii(entity) for _, entity in FACTS.values()}
            cut = {"invoice": F.col("issued_date"), "ticket": F.col("opened_at"), "usage": F.col("month")}
            old = {"invoice": "2000-04", "ticket": "2023-11", "usage": "2023-06"}
            last = {"invoice": "2001-01", "ticket": "2024-01", "usage": "2024-01"}
            first, second = {"customer": result.without_pii("customer")}, {}
            for entity, frame in whole.items():
                month = F.date_format(cut[entity], "yyyy-MM")
                wrong = (month == old[entity]) & (F.pmod(F.xxhash64("customer_id"), F.lit(3)) == 0)
                first[entity] = frame.filter((month < last[entity]) & ~wrong)
                second[entity] = frame.filter((month >= last[entity]) | (month == old[entity]))
            place = Store.fresh(spark, "monthly").folder
            MonthlyMarts.open(spark, place).deliver(first)
            _kept_by_month[key] = MonthlyMarts.open(spark, place).deliver(second)
        return _kept_by_month[key]


@_query
def customer_360_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """customer_360 from partial aggregates, after a late correction: equal to one built from all facts."""
    return plain(monthly(spark, folder).table("customer_360")).orderBy("health_score", "customer_id")


@_query
def fact_invoice_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return plain(monthly(spark, folder).table("fact_invoice").drop("of_month"), MAY_LACK)


@_query
def fact_ticket_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return plain(monthly(spark, folder).table("fact_ticket").drop("of_month"), MAY_LACK)


@_query
def revenue_of_a_year(spark: SparkSession, folder: str) -> DataFrame:
    """Invoiced amounts of 2000 by day and product; reads the files of those months."""
    invoices = monthly(spark, folder).between("fact_invoice", date(2000, 1, 1), date(2000, 12, 31))
    amount = rollups.exact_sum(F.col("amount_gbp")).cast("double").alias("amount_gbp")
    return plain(invoices.groupBy("issued_date", "product").agg(F.count("*").alias("invoices"), amount))


# --- Metrics and saved questions --------------------------------------------


@_query
def kpis(spark: SparkSession, folder: str) -> DataFrame:
    built = marts(spark, folder)
    return metrics.kpis(built.table("customer_360"), built.table("fact_ticket"))


@_query
def kpi_display(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.kpi_display(kpis(spark, folder))


@_query
def sla_compliance(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.sla_compliance(_mart(spark, folder, "fact_ticket"))


_REPORTS = {
    **metrics.VIEWS,
    "top_at_risk": ("customer_360", metrics.top_at_risk),
    "top_debtors": ("customer_360", metrics.top_debtors),
    "breach_rate_by_category": ("fact_ticket", metrics.breach_rate_by_category),
    "mrr_by_product": ("fact_invoice", metrics.mrr_by_product),
}


def _register_report(name: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        mart, report = _REPORTS[name]
        return plain(report(_mart(spark, folder, mart)))

    _QUERIES[name] = query


for _name in _REPORTS:
    _register_report(_name)


# --- Policies ---------------------------------------------------------------


@_query
def health_bands(spark: SparkSession, folder: str) -> DataFrame:
    return plain(policies.health_bands(_mart(spark, folder, "customer_360"), load_bands()))


@_query
def overdue_stages(spark: SparkSession, folder: str) -> DataFrame:
    return plain(policies.overdue_stages(_mart(spark, folder, "fact_invoice"), load_bands()))


@_query
def credit_holds(spark: SparkSession, folder: str) -> DataFrame:
    return plain(policies.credit_holds(_mart(spark, folder, "customer_360"), load_bands()))


@_query
def service_credits(spark: SparkSession, folder: str) -> DataFrame:
    return plain(policies.service_credits(_mart(spark, folder, "customer_360"), load_bands()))


@_query
def upsell_without_breaches(spark: SparkSession, folder: str) -> DataFrame:
    built = marts(spark, folder)
    return plain(policies.may_be_offered_more(built.table("customer_360"), built.table("fact_ticket"), load_bands()))


# --- Rules and actions ------------------------------------------------------


def _register_rule(rule: dict) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        marts(spark, folder).register()
        return actions.rule_hits(spark, rule)

    _QUERIES[f"rule_{rule['id']}"] = query


for _rule in load_rules():
    _register_rule(_rule)


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    marts(spark, folder).register()
    return actions.all_hits(spark, load_rules())


def _first_run(spark: SparkSession, folder: str) -> DataFrame:
    """The log after one run over an empty one."""
    return actions.new_actions(_hits(spark, folder), actions.empty_log(spark), RUN_AT, 1)


@_query
def open_actions(spark: SparkSession, folder: str) -> DataFrame:
    return plain(actions.open_actions(_first_run(spark, folder)))


@_query
def actions_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    return actions.actions_by_rule(_first_run(spark, folder))


@_query
def actions_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    return actions.actions_by_owner(_first_run(spark, folder))


@_query
def action_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return actions.action_metrics(_first_run(spark, folder))


def _log(spark: SparkSession, folder: str) -> actions.ActionLog:
    """A log on disk after one run over the marts."""
    marts(spark, folder).register()
    log = actions.ActionLog(spark, Store.fresh(spark, "action-log").folder)
    log.run_rules(load_rules(), at=RUN_AT)
    return log


def _reopened(log: actions.ActionLog) -> actions.ActionLog:
    """The same folder, as a later application opens it."""
    return actions.ActionLog(log.spark, log.folder)


def _third() -> Column:
    return F.substring("customer_id", 3, 20).cast("bigint") % 3 == 0


@_query
def actions_second_run(spark: SparkSession, folder: str) -> DataFrame:
    """The state after running twice: every action still dates from the first run."""
    log = _reopened(_log(spark, folder))
    log.run_rules(load_rules(), at=RUN_AGAIN_AT)
    return plain(_with_turns(actions.state(log.entries()), log))


@_query
def actions_reopen(spark: SparkSession, folder: str) -> DataFrame:
    """Run, close the actions of every third customer, run again: the closed ones open anew."""
    log = _log(spark, folder)
    log.close(_third())
    log = _reopened(log)
    log.run_rules(load_rules(), at=RUN_AGAIN_AT)
    return plain(_with_turns(actions.state(log.entries()), log))


@_query
def actions_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """As ``actions_reopen``, read from the one part that is left after compaction."""
    log = _log(spark, folder)
    log.close(_third())
    log.run_rules(load_rules(), at=RUN_AGAIN_AT)
    log.compact()
    return plain(_with_turns(_reopened(log).entries(), log))


def _with_turns(entries: DataFrame, log: actions.ActionLog) -> DataFrame:
    """Runs are numbered by the clock; the check numbers them as the log's versions, the closing being the second."""
    turn = None
    for number in reversed(log.versions.numbers()):
        made = F.when(F.col("run") == log.versions.read(number).content["run"], number)
        turn = made if turn is None else made.otherwise(turn)
    return entries.withColumn("run", turn.cast("bigint"))


@_query
def rule_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per rule, matches and new actions of a run with two thirds of the actions open already."""
    log = _first_run(spark, folder)
    log = log.unionByName(actions.closing(log, _third(), 2))
    hits = _hits(spark, folder)
    return actions.rule_audit(hits, actions.new_actions(hits, log, RUN_AGAIN_AT, 3), load_rules())


# --- Text and search --------------------------------------------------------


@_query
def redact_documents(spark: SparkSession, folder: str) -> DataFrame:
    clean = redact(F.col("text"))
    return spread_table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", F.md5(clean).alias("redacted_md5"), F.length(clean).alias("redacted_chars")
    )


@_query
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        F.size(raw_tokens(F.col("text"))).alias("tokens"),
        F.size(search_tokens(F.col("text"))).alias("search_tokens"),
    )


@_query
def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread_table(spark, folder, "documents", "doc_id", "text")
    return bm25.term_frequencies(documents, "doc_id", F.col("text"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "documents", "doc_id", "source", "text").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("heading"), "text"
    )


@_query
def bm25_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    store = Store.fresh(spark, "terms")
    return plain(bm25.term_stats(_chunks(spark, folder), store=store))


@_query
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return plain(bm25.search(_chunks(spark, folder), asked, store=Store.fresh(spark, "search")))


def passage_index(spark: SparkSession, folder: str) -> PassageIndex:
    """The kept index of all documents, built once for each application and folder: nine tenths, then the rest."""
    key = (spark.sparkContext.applicationId, folder)
    with _lock:
        if key not in _indexed:
            chunks, last = _chunks(spark, folder), F.col("chunk_id") % 10 == 9
            index = PassageIndex.open(spark, Store.fresh(spark, "passages").folder)
            _indexed[key] = index.add(chunks.filter(~last)).add(chunks.filter(last))
        return _indexed[key]


def _passages_asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@_query
def passage_search(spark: SparkSession, folder: str) -> DataFrame:
    """As ``bm25_search``, over the kept index: two segments, most pairs never scored."""
    return plain(passage_index(spark, folder).search(_passages_asked(spark, folder)).best)


@_query
def passage_search_after_deletion(spark: SparkSession, folder: str) -> DataFrame:
    """The same search after every fourth document has been taken out of a copy of the index."""
    chunks = _chunks(spark, folder)
    index = PassageIndex.open(spark, Store.fresh(spark, "passages").folder).add(chunks)
    index = index.delete(chunks.filter(F.col("chunk_id") % 4 == 1))
    return plain(index.search(_passages_asked(spark, folder)).best)


@_query
def passage_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies summed over the segments of the kept index."""
    return plain(passage_index(spark, folder).term_stats())


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: each line opens a section headed by its first sentence, and a line
    with an e-mail address sets a new title."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.when((i > 0) & F.contains(x, F.lit("@")), F.lit("# "))
            .when(i > 0, F.lit("## "))
            .otherwise(F.lit("")),
            F.replace(x, F.lit(". "), F.lit(".\n")),
        ),
    )
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.array_join(lines, "\n"))
    documents = spread_table(spark, folder, "documents", "doc_id", "source", "text")
    return documents.select(F.col("doc_id").alias("doc"), text.alias("text"))


@_query
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunk_markdown(markdown(spark, folder))
    return chunks.select("doc", "position", "title", "heading", F.md5("text").alias("text_md5"))


@_query
def files_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """As ``chunk_documents``, from a folder of Markdown files."""
    place = Store.fresh(spark, "markdown").folder
    deliver_markdown(markdown(spark, folder), place)
    chunks = chunk_markdown(read_markdown(spark, place))
    return chunks.select("doc", "position", "title", "heading", F.md5("text").alias("text_md5"))


@_query
def intent_classify(spark: SparkSession, folder: str) -> DataFrame:
    sorted_out = questions.classify(user_questions(spark, folder))
    return sorted_out.select("question_id", "intent", F.md5("search").alias("search_md5"))


@_query
def question_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the best matching passage of ``benchmark``."""
    passages = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("chunk_id"),
        F.concat(F.lit("Handbook "), (F.col("item_id") % 7).cast("string")).alias("title"),
        F.concat(F.lit("Policy "), F.col("item_id").cast("string")).alias("heading"),
        "text",
    )
    asked = questions.classify(user_questions(spark, folder))
    return plain(questions.with_policy(asked, passages, Store.fresh(spark, "policy")), ("chunk_id",))


# --- Governed queries -------------------------------------------------------


def _governed(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    built = marts(spark, folder)
    paths = {name: built.store.path(name) for name in mart_plans.TABLES}
    return GovernedSession(spark, paths).query(sql)


@_query
def governed_query(spark: SparkSession, folder: str) -> DataFrame:
    return plain(
        _governed(
            spark,
            folder,
            """
            WITH busy AS (SELECT customer_id, count(*) AS tickets FROM fact_ticket GROUP BY customer_id)
            SELECT customer_id, company_name, health_score, tickets
            FROM customer_360 JOIN busy USING (customer_id)
            ORDER BY health_score, customer_id
            """,
        )
    )


@_query
def governed_query_json(spark: SparkSession, folder: str) -> DataFrame:
    return as_records(
        _governed(
            spark,
            folder,
            """
            SELECT customer_id, customer_since, seats, round(health_score, 1) AS health, avg_csat IS NULL AS quiet
            FROM customer_360 ORDER BY health_score, customer_id;
            """,
        )
    )


@_query
def governed_query_setops(spark: SparkSession, folder: str) -> DataFrame:
    return _governed(
        spark,
        folder,
        """
        SELECT * FROM (
          (SELECT customer_id FROM fact_invoice WHERE days_outstanding > 45
           UNION SELECT customer_id FROM fact_ticket WHERE sla_breached)
          INTERSECT SELECT customer_id FROM fact_usage
          EXCEPT SELECT customer_id FROM customer_360 WHERE health_score >= 95
        ) ORDER BY customer_id
        """,
    )


# --- Audit ------------------------------------------------------------------


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    loads = audit_rows(
        dirty_ingest(spark, folder).lineage(),
        "ingestion",
        F.concat(F.lit("load:"), F.col("entity")),
        {"rows_in": F.col("rows_in"), "rows_loaded": F.col("rows_loaded")},
        RUN_AT,
        1,
    )
    rules = audit_rows(
        rule_audit(spark, folder),
        "automation",
        F.col("rule_id"),
        {"matches": F.col("matches"), "new_actions": F.col("new_actions")},
        RUN_AGAIN_AT,
        2,
    )
    return loads.unionByName(rules)


def _logged(spark: SparkSession, folder: str) -> AuditLog:
    """The audit entries in a log on disk, an append for each layer."""
    log, entries = AuditLog(spark, Store.fresh(spark, "audit").folder), _audit(spark, folder)
    for layer in ("ingestion", "automation"):
        log.append(entries.filter(F.col("layer") == layer))
    return log


@_query
def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    return _logged(spark, folder).entries().withColumn("detail", F.to_json("detail"))


@_query
def audit_tail(spark: SparkSession, folder: str) -> DataFrame:
    return _logged(spark, folder).tail(5).withColumn("detail", F.to_json("detail"))


@_query
def audit_of_a_day(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the day of the second run; other days' files are not read."""
    day = RUN_AGAIN_AT.date()
    return _logged(spark, folder).entries(day, day).withColumn("detail", F.to_json("detail"))
