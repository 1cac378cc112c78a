"""The reporting dataset: one customer dimension, three fact tables and customer_360."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.health import components, health_score
from tallyhouse.operators import rollups
from tallyhouse.operators.ingest import IngestResult
from tallyhouse.sources.store import Store

# --- Fixed values -----------------------------------------------------------
SLA_HOURS = {"P1": 4, "P2": 8, "P3": 24, "P4": 72}
GRACE_DAYS = 30  # the as-of date lies this long after the newest invoice
# ----------------------------------------------------------------------------

TABLES = ("dim_customer", "fact_invoice", "fact_ticket", "fact_usage", "customer_360")
# Rows are sorted by these inside each file, so date filters skip row groups.
LAYOUT = {"fact_invoice": "issued_date", "fact_ticket": "opened_at", "fact_usage": "month"}


def dim_customer(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        "company_name",
        "sector",
        "town",
        "account_manager",
        F.col("customer_since").cast("date").alias("customer_since"),
        F.col("seats").cast("int").alias("seats"),
    )


def fact_invoice(invoices: DataFrame) -> DataFrame:
    as_of = F.date_add(rollups.latest(invoices, "issued_date"), GRACE_DAYS)
    issued, paid = F.col("issued_date"), F.col("paid_date")
    return invoices.select(
        "invoice_id",
        "customer_id",
        "product",
        F.col("amount_gbp").cast("double").alias("amount_gbp"),
        issued,
        paid,
        F.datediff(paid, issued).cast("bigint").alias("days_to_pay"),
        F.when(paid.isNull(), F.datediff(as_of, issued)).cast("bigint").alias("days_outstanding"),
    )


def _whole_minutes(moment: Column) -> Column:
    """Minute number of a timestamp, so that differences count minute boundaries crossed."""
    return F.unix_date(moment.cast("date")) * F.lit(1440) + F.hour(moment) * F.lit(60) + F.minute(moment)


def fact_ticket(tickets: DataFrame) -> DataFrame:
    opened, resolved = F.col("opened_at"), F.col("resolved_at")
    targets = F.create_map(*(F.lit(part) for pair in SLA_HOURS.items() for part in pair))
    hours = (_whole_minutes(resolved) - _whole_minutes(opened)) / F.lit(60.0)
    return tickets.select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"),
        "customer_id",
        "priority",
        "category",
        opened.cast("timestamp_ntz").alias("opened_at"),
        resolved.cast("timestamp_ntz").alias("resolved_at"),
        hours.alias("resolution_hours"),
        F.try_element_at(targets, F.col("priority")).alias("sla_hours"),
        F.col("csat_score").cast("int").alias("csat_score"),
    ).select(
        "ticket_id",
        "customer_id",
        "priority",
        "category",
        "opened_at",
        "resolved_at",
        "resolution_hours",
        "sla_hours",
        F.coalesce(F.col("resolution_hours") > F.col("sla_hours"), F.lit(False)).alias("sla_breached"),
        "csat_score",
    )


def fact_usage(usage: DataFrame) -> DataFrame:
    return usage.select(
        "customer_id",
        F.col("month").cast("date").alias("month"),
        F.col("voice_minutes").cast("int").alias("voice_minutes"),
        F.col("data_gb").cast("double").alias("data_gb"),
        F.col("outage_minutes").cast("int").alias("outage_minutes"),
    )


# What a customer without invoices, tickets or usage shows; satisfaction stays unknown.
EMPTY = {
    "monthly_revenue_gbp": 0.0,
    "product_count": 0,
    "overdue_gbp": 0.0,
    "tickets_90d": 0,
    "sla_breaches_90d": 0,
    "avg_csat": None,
    "outage_minutes_3m": 0,
    "data_growth_pct": 0.0,
}


def _metric(name: str) -> Column:
    column, empty = F.col(name), EMPTY[name]
    return column if empty is None else F.coalesce(column, F.lit(empty)).alias(name)


def customer_metrics(
    customers: DataFrame, invoices: DataFrame, tickets: DataFrame, usage: DataFrame
) -> DataFrame:
    """Each customer with the four rollups beside it.

    Every rollup is partitioned by customer_id already, so the joins move only the customers.
    """
    return beside(
        customers,
        rollups.revenue(invoices),
        rollups.overdue_debt(invoices),
        rollups.tickets_90d(tickets),
        rollups.usage_trend(usage),
    )


def beside(customers: DataFrame, *per_customer: DataFrame) -> DataFrame:
    """Customers with rollups of one row each beside them, gaps filled."""
    joined = customers
    for rollup in per_customer:
        joined = joined.join(rollup, "customer_id", "left")
    return joined.select(*customers.columns, *(_metric(name) for name in EMPTY))


_SCORED = (
    "sla_breaches_90d",
    "overdue_gbp",
    "outage_minutes_3m",
    "avg_csat",
    "data_growth_pct",
)


def customer_360(
    customers: DataFrame, invoices: DataFrame, tickets: DataFrame, usage: DataFrame
) -> DataFrame:
    """One wide row per customer with the health score."""
    return scored(customer_metrics(customers, invoices, tickets, usage))


def scored(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("health_score", health_score(*(F.col(name) for name in _SCORED)))


def health_components(wide: DataFrame) -> DataFrame:
    """Why an account scores what it scores."""
    parts = components(*(F.col(name) for name in _SCORED))
    return wide.select("customer_id", *(c.alias(n) for n, c in parts.items()), "health_score")


_BUILD = {
    "dim_customer": ("customer", dim_customer),
    "fact_invoice": ("invoice", fact_invoice),
    "fact_ticket": ("ticket", fact_ticket),
    "fact_usage": ("usage", fact_usage),
}


class Marts:
    """The reporting tables of one ingest, written to a store and read from there."""

    def __init__(self, ingested: IngestResult, store: Store):
        self.ingested = ingested
        self.store = store

    def _fact(self, name: str) -> DataFrame:
        entity, select = _BUILD[name]
        frame = select(self.ingested.without_pii(entity))
        return frame.sortWithinPartitions(LAYOUT[name]) if name in LAYOUT else frame

    def build(self) -> "Marts":
        """Write the dimension and the facts, then the wide table that reads them."""
        base = self.store.write_all({name: self._fact(name) for name in _BUILD})
        self.store.write("customer_360", customer_360(*base.values()))
        return self

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def register(self, names: tuple[str, ...] = TABLES) -> None:
        """Make tables available to SQL under their names."""
        for name in names:
            self.table(name).createOrReplaceTempView(name)
