"""The marts kept month by month, in versions, with a customer_360 that follows from changed months.

Facts are partitioned by month. A delivery replaces the months it has rows of and leaves the others alone; it is
written beside what is there, and one commit makes the new version out of new and old months. A reader holds
on to the version it opened.

Beside each month of facts lie partial aggregates by customer, which can be added up: customer_360 is built from those,
so a delivery reads the facts of its own months and, because the ticket window begins in the middle of one, of one
month more. The dates that windows hang on are part of the version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import rollups
from tallyhouse.operators.ingest import CUSTOMER, IngestResult
from tallyhouse.plans import marts
from tallyhouse.sources.versions import ATTEMPTS, Conflict, Version, Versions

#: The date that puts a row into its month, and the entity that a fact comes from.
FACTS = {
    "fact_invoice": ("issued_date", "invoice"),
    "fact_ticket": ("opened_at", "ticket"),
    "fact_usage": ("month", "usage"),
}
MONTH = "of_month"
#: Where rows without a readable date are kept.
NO_MONTH = "none"
DELIVERY = "v"


def _month(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM"), F.lit(NO_MONTH))


def _rows(name: str, frame: DataFrame) -> DataFrame:
    """A fact as it is kept: nothing in it depends on other months."""
    if name == "fact_invoice":
        return marts.fact_invoice(frame).drop("days_outstanding")
    return {"fact_ticket": marts.fact_ticket, "fact_usage": marts.fact_usage}[name](frame)


# --- Partial aggregates -------------------------------------------------------


def _tickets(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy(MONTH, "customer_id").agg(
        F.count("*").alias("tickets"),
        F.count_if("sla_breached").alias("breaches"),
        F.sum("csat_score").alias("csat"),
        F.count("csat_score").alias("answers"),
    )


def partials(name: str, facts: DataFrame) -> DataFrame:
    """What customer_360 needs of months of facts, by month and customer; rows can be added up."""
    if name == "fact_invoice":
        amount, unpaid = F.col("amount_gbp"), F.col("paid_date").isNull()
        return facts.groupBy(MONTH, "customer_id", "issued_date").agg(
            rollups.exact_sum(amount).alias("amount"),
            rollups.exact_sum(F.when(unpaid, amount)).alias("unpaid"),
            F.collect_set("product").alias("products"),
        )
    if name == "fact_ticket":
        return _tickets(facts)
    return facts.groupBy(MONTH, "customer_id", "month").agg(
        F.sum("data_gb").alias("gb"), F.count("data_gb").alias("rows"), F.sum("outage_minutes").alias("outage")
    )


def _revenue(invoices: DataFrame, newest: date) -> DataFrame:
    last = invoices.filter(F.col("issued_date") == F.lit(newest))
    return last.select("customer_id", F.col("amount").cast("double").alias("monthly_revenue_gbp"), F.size("products").cast("long").alias("product_count"))


def _overdue(invoices: DataFrame, newest: date) -> DataFrame:
    late = F.datediff(F.lit(newest + timedelta(days=marts.GRACE_DAYS)), F.col("issued_date")) > rollups.OVERDUE_AFTER_DAYS
    return invoices.filter(late & F.col("unpaid").isNotNull()).groupBy("customer_id").agg(F.sum("unpaid").cast("double").alias("overdue_gbp"))


def _ticket_window(parts: DataFrame) -> DataFrame:
    whole = parts.groupBy("customer_id").agg(*(F.sum(c).alias(c) for c in ("tickets", "breaches", "csat", "answers")))
    return whole.select(
        "customer_id",
        F.col("tickets").alias("tickets_90d"),
        F.col("breaches").alias("sla_breaches_90d"),
        F.when(F.col("answers") > 0, F.col("csat") / F.col("answers")).alias("avg_csat"),
    )


def _usage_trend(parts: DataFrame, newest: date) -> DataFrame:
    top = F.lit(newest)
    recent = F.col("month") > top - F.expr(f"INTERVAL '{rollups.RECENT_MONTHS}' MONTH")
    base = F.col("month") <= top - F.expr(f"INTERVAL '{rollups.BASE_MONTHS}' MONTH")

    def mean(when: Column) -> Column:
        rows = F.nullif(F.sum(F.when(when, F.col("rows"))), F.lit(0))
        return F.sum(F.when(when, F.col("gb"))) / rows

    growth = F.lit(100.0) * (mean(recent) / F.nullif(mean(base), F.lit(0.0)) - F.lit(1.0))
    return parts.groupBy("customer_id").agg(
        F.sum(F.when(recent, F.col("outage")).otherwise(0)).alias("outage_minutes_3m"), growth.alias("data_growth_pct")
    )


# --- The marts ----------------------------------------------------------------


class MonthlyMarts:
    """One version of the marts below a folder."""

    def __init__(self, spark: SparkSession, folder: str, version: Version):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.version = version
        self.versions = Versions(spark, self.folder)
        #: Months of facts that were read to make this version, by table.
        self.months_read: dict[str, list[str]] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "MonthlyMarts":
        return cls(spark, folder, Versions(spark, folder).latest())

    def months(self, name: str) -> list[str]:
        return sorted(self.version.content.get("months", {}).get(name, {}))

    def _read(self, kind: str, name: str, deliveries: dict[str, str], schema: str) -> DataFrame:
        """Months of a table; month and delivery are partition columns, so filters on the month skip files."""
        base = f"{self.folder}/{kind}/{name}"
        paths = [f"{base}/{DELIVERY}={delivery}/{MONTH}={month}" for month, delivery in sorted(deliveries.items())]
        full = f"{schema}, {DELIVERY} string, {MONTH} string"
        if not paths:
            return self.spark.createDataFrame([], full).drop(DELIVERY)
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths).drop(DELIVERY)

    def _facts(self, content: dict, name: str, months: Iterable[str] | None = None) -> DataFrame:
        deliveries = content["months"][name]
        wanted = deliveries if months is None else {m: deliveries[m] for m in months if m in deliveries}
        return self._read("facts", name, wanted, content["schemas"][name])

    def _partials(self, content: dict, name: str) -> DataFrame:
        return self._read("partials", name, content["months"][name], content["schemas"][f"{name}_partials"])

    def _shown(self, name: str, facts: DataFrame) -> DataFrame:
        """The fact with what depends on the version's dates."""
        if name != "fact_invoice" or not self.version.content["newest"].get(name):
            return facts
        as_of = date.fromisoformat(self.version.content["newest"][name]) + timedelta(days=marts.GRACE_DAYS)
        outstanding = F.when(F.col("paid_date").isNull(), F.datediff(F.lit(as_of), F.col("issued_date"))).cast("bigint")
        columns = [c for c in facts.columns if c != MONTH]
        return facts.select(*columns, outstanding.alias("days_outstanding"), MONTH)

    def table(self, name: str) -> DataFrame:
        """A table of this version; facts have their month as ``of_month``."""
        content = self.version.content
        if name in FACTS:
            return self._shown(name, self._facts(content, name))
        return self.spark.read.parquet(f"{self.folder}/{name}/{content[name]}")

    def between(self, name: str, first: date, last: date) -> DataFrame:
        """A fact's rows of some days. Only months that the days lie in are looked at, whatever lies beside them."""
        months = [m for m in self.months(name) if first.isoformat()[:7] <= m <= last.isoformat()[:7]]
        day = F.col(FACTS[name][0]).cast("date")
        return self._shown(name, self._facts(self.version.content, name, months)).filter(day.between(F.lit(first), F.lit(last)))

    # --- Deliveries ---

    def deliver(self, ingested: IngestResult | dict[str, DataFrame]) -> "MonthlyMarts":
        """Replace the months that a delivery has rows of, and the customers if it has any; return the new version.

        A delivery that finds another one committed meanwhile is put on top of that; its data is not written again.
        """
        frames = ingested if isinstance(ingested, dict) else {e: ingested.without_pii(e) for e in (CUSTOMER, *(e for _, e in FACTS.values()))}
        delivery, written = uuid.uuid4().hex, {}
        for name, (_, entity) in FACTS.items():
            if entity in frames:
                written[name] = self._write_months(name, delivery, frames[entity])
        if CUSTOMER in frames:
            marts.dim_customer(frames[CUSTOMER]).write.parquet(f"{self.folder}/dim_customer/{delivery}")
        for _ in range(ATTEMPTS):
            now = self.versions.latest()
            after = MonthlyMarts(self.spark, self.folder, now)
            content = after._with(delivery, written, CUSTOMER in frames)
            try:
                after.version = self.versions.commit(now, content)
                return after
            except Conflict:
                continue
        raise Conflict(f"Gave up after {ATTEMPTS} conflicts below {self.folder}")

    def _write_months(self, name: str, delivery: str, frame: DataFrame) -> dict:
        """Write a delivery's rows and partial aggregates by month; which months, and the schemas."""
        rows = _rows(name, frame)
        placed = rows.withColumn(MONTH, _month(F.col(FACTS[name][0])))
        path = lambda kind: f"{self.folder}/{kind}/{name}/{DELIVERY}={delivery}"
        # One file or a few for a month: AQE splits large months and joins small ones.
        placed.hint("rebalance", MONTH).sortWithinPartitions(MONTH, FACTS[name][0]).write.partitionBy(MONTH).parquet(path("facts"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        facts = self.spark.read.schema(f"{schema}, {MONTH} string").parquet(path("facts"))
        parts = partials(name, facts)
        parts.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(path("partials"))
        part_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != MONTH)
        months = [row[0] for row in facts.select(MONTH).distinct().collect()]  # as many as the calendar has
        return {"months": months, "schemas": {name: schema, f"{name}_partials": part_schema}}

    def _with(self, delivery: str, written: dict[str, dict], customers: bool) -> dict:
        """The content of the version that comes after this one."""
        old = self.version.content
        content = {
            "months": {name: dict(old.get("months", {}).get(name, {})) for name in FACTS},
            "schemas": dict(old.get("schemas", {})),
            "newest": dict(old.get("newest", {})),
            "dim_customer": delivery if customers else old.get("dim_customer"),
        }
        self.months_read = {name: sorted(found["months"]) for name, found in written.items()}
        for name, found in written.items():
            content["months"][name] |= {month: delivery for month in found["months"]}
            content["schemas"] |= found["schemas"]
            content["newest"][name] = self._newest(content, name)
        if content["dim_customer"] and all(name in content["schemas"] for name in FACTS):
            wide = uuid.uuid4().hex
            self._customer_360(content).write.parquet(f"{self.folder}/customer_360/{wide}")
            content["customer_360"] = wide
        return content

    def _newest(self, content: dict, name: str) -> str | None:
        """The latest date of a fact, from its latest month."""
        months = [month for month in content["months"][name] if month != NO_MONTH]
        if not months:
            return None
        top = self._facts(content, name, [max(months)]).agg(F.max(FACTS[name][0])).first()[0]
        self.months_read[name] = sorted({*self.months_read[name], max(months)})
        return top.isoformat()

    def _customer_360(self, content: dict) -> DataFrame:
        customers = self.spark.read.parquet(f"{self.folder}/dim_customer/{content['dim_customer']}")
        newest = content["newest"]
        invoices, usage = self._partials(content, "fact_invoice"), self._partials(content, "fact_usage")
        day = lambda name: date.fromisoformat(newest[name] or "1970-01-01")  # no rows have a date then
        return marts.scored(
            marts.beside(
                customers,
                _revenue(invoices, day("fact_invoice")),
                _overdue(invoices, day("fact_invoice")),
                _ticket_window(self._ticket_parts(content)),
                _usage_trend(usage, day("fact_usage")),
            )
        )

    def _ticket_parts(self, content: dict) -> DataFrame:
        """Partial aggregates of the months inside the ticket window, and of the rows inside it of the month it begins in."""
        parts, top = self._partials(content, "fact_ticket"), content["newest"]["fact_ticket"]
        if not top:
            return parts
        start = datetime.fromisoformat(top) - timedelta(days=rollups.TICKET_WINDOW_DAYS)
        first = start.isoformat()[:7]
        inside = parts.filter((F.col(MONTH) > first) & (F.col(MONTH) != NO_MONTH))
        if first not in content["months"]["fact_ticket"]:
            return inside
        self.months_read["fact_ticket"] = sorted({*self.months_read.get("fact_ticket", []), first})
        opened = self._facts(content, "fact_ticket", [first]).filter(F.col("opened_at") >= F.lit(start.isoformat()).cast("timestamp_ntz"))
        return inside.unionByName(_tickets(opened))
