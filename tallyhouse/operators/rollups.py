"""Per-customer aggregates. Each reduces inside its task first, so a customer with a third of
all rows sends one row per task into the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERDUE_AFTER_DAYS = 45
TICKET_WINDOW_DAYS = 90
RECENT_MONTHS, BASE_MONTHS = 3, 9


def exact_sum(amount: Column) -> Column:
    """A sum of money. Added up as decimals: the sum of doubles depends on the order of tasks."""
    return F.sum(amount.cast("decimal(24,6)"))


def latest(frame: DataFrame, column: str, before: str | None = None) -> Column:
    """The largest value of a column, or an interval before it, as a scalar subquery.

    The subtraction is inside, so a filter on the result still reaches the Parquet scan.
    """
    top = F.max(column)
    return frame.select(top - F.expr(f"INTERVAL {before}") if before else top).scalar()


def in_ticket_window(tickets: DataFrame) -> Column:
    """Opened within 90 days of the newest ticket; the data sets the date, not the clock."""
    return F.col("opened_at") >= latest(tickets, "opened_at", f"'{TICKET_WINDOW_DAYS}' DAY")


def revenue(invoices: DataFrame) -> DataFrame:
    """Revenue and product lines on the latest issue date."""
    return (
        invoices.filter(F.col("issued_date") == latest(invoices, "issued_date"))
        .groupBy("customer_id")
        .agg(
            exact_sum(F.col("amount_gbp")).cast("double").alias("monthly_revenue_gbp"),
            F.countDistinct("product").alias("product_count"),
        )
    )


def overdue_debt(invoices: DataFrame) -> DataFrame:
    """Unpaid invoices more than 45 days after issue."""
    return (
        invoices.filter(F.col("paid_date").isNull() & (F.col("days_outstanding") > OVERDUE_AFTER_DAYS))
        .groupBy("customer_id")
        .agg(exact_sum(F.col("amount_gbp")).cast("double").alias("overdue_gbp"))
    )


def tickets_90d(tickets: DataFrame) -> DataFrame:
    return (
        tickets.filter(in_ticket_window(tickets))
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("tickets_90d"),
            F.count_if("sla_breached").alias("sla_breaches_90d"),
            F.avg("csat_score").alias("avg_csat"),
        )
    )


def usage_trend(usage: DataFrame) -> DataFrame:
    """Outage minutes of the last three months, and data growth against nine months ago and before."""
    recent = F.col("month") > latest(usage, "month", f"'{RECENT_MONTHS}' MONTH")
    base = F.col("month") <= latest(usage, "month", f"'{BASE_MONTHS}' MONTH")
    recent_gb = F.avg(F.when(recent, F.col("data_gb")))
    base_gb = F.nullif(F.avg(F.when(base, F.col("data_gb"))), F.lit(0.0))
    return usage.groupBy("customer_id").agg(
        F.sum(F.when(recent, F.col("outage_minutes")).otherwise(0)).alias("outage_minutes_3m"),
        (F.lit(100.0) * (recent_gb / base_gb - F.lit(1.0))).alias("data_growth_pct"),
    )
