"""What the written policies say about accounts: bands, credit holds, service credits, who may be offered more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import rollups
from tallyhouse.operators.bands import Bands


def health_bands(wide: DataFrame, bands: dict[str, Bands]) -> DataFrame:
    band = bands["health_band"].outcome(F.col("health_score"))
    return wide.select("customer_id", "company_name", "health_score", band.alias("band"))


def overdue_stages(invoices: DataFrame, bands: dict[str, Bands]) -> DataFrame:
    """Unpaid invoices and the step that is due, by the procedure that held when they were issued."""
    stage = bands["overdue_stage"].outcome(F.col("days_outstanding"), F.col("issued_date"))
    unpaid = invoices.filter(F.col("paid_date").isNull())
    return unpaid.select("invoice_id", "customer_id", "amount_gbp", "days_outstanding", stage.alias("stage"))


def credit_holds(wide: DataFrame, bands: dict[str, Bands]) -> DataFrame:
    """Accounts that owe something beyond the days of grace, and whether orders stop."""
    owing = wide.filter(F.col("overdue_gbp") > 0)
    hold = bands["credit_hold"].outcome(F.col("overdue_gbp")) == "yes"
    return owing.select("customer_id", "company_name", "account_manager", "overdue_gbp", hold.alias("on_hold"))


def service_credits(wide: DataFrame, bands: dict[str, Bands]) -> DataFrame:
    """What is offered for repeated breaches: a share of the month's charge."""
    percent = bands["service_credit"].outcome(F.col("sla_breaches_90d")).cast("int")
    entitled = wide.select("customer_id", "company_name", "sla_breaches_90d", "monthly_revenue_gbp", percent.alias("credit_percent"))
    credit = F.col("monthly_revenue_gbp") * F.col("credit_percent") / F.lit(100.0)
    return entitled.filter(F.col("credit_percent") > 0).withColumn("credit_gbp", credit)


def open_breaches(tickets: DataFrame) -> DataFrame:
    """Open tickets beyond their target, per customer; the newest ticket sets the time, not the clock."""
    newest = rollups.latest(tickets, "opened_at")
    hours = (F.unix_micros(newest.cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / F.lit(3_600_000_000.0)
    late = tickets.filter(F.col("resolved_at").isNull() & (hours > F.col("sla_hours")))
    return late.groupBy("customer_id").agg(F.count("*").alias("open_breaches"))


def may_be_offered_more(wide: DataFrame, tickets: DataFrame, bands: dict[str, Bands]) -> DataFrame:
    """Healthy accounts with growing usage that have no open breach, and how many breaches keep the others out."""
    healthy = bands["health_band"].outcome(F.col("health_score")) == "healthy"
    growing = wide.filter(healthy & (F.col("data_growth_pct") > 0))
    found = growing.join(open_breaches(tickets), "customer_id", "left")
    breaches = F.coalesce("open_breaches", F.lit(0)).cast("bigint")
    return found.select("customer_id", "company_name", "data_growth_pct", breaches.alias("open_breaches"), (breaches == 0).alias("offer"))
