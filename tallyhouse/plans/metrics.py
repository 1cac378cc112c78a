"""Named KPIs and report views, each defined once over the marts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.health import AT_RISK_BELOW
from tallyhouse.operators.rollups import exact_sum, in_ticket_window, latest

# --- Fixed values: KPI names and labels -------------------------------------
KPI_LABELS = {
    "monthly_recurring_revenue": "Monthly recurring revenue (£)",
    "overdue_debt": "Overdue debt > 45 days (£)",
    "sla_compliance": "SLA compliance, last 90 days (%)",
    "at_risk_accounts": "Accounts at risk (health < 40)",
    "revenue_at_risk": "Revenue at risk (£ / month)",
    "avg_csat": "Average CSAT, last 90 days (1–5)",
}
COUNTS = ("at_risk_accounts",)
NO_VALUE = "–"
# ----------------------------------------------------------------------------


def _at_risk() -> Column:
    return F.col("health_score") < AT_RISK_BELOW


def _percent(flag: Column) -> Column:
    """Share of rows, in percent with one decimal; a NULL flag counts as no."""
    return F.round(100.0 * F.avg(F.when(flag, 1).otherwise(0)), 1)


def _gbp(amount: Column) -> Column:
    """Whole pounds of an exact sum; sums that end in 50 pence round up in any order of tasks."""
    return F.round(exact_sum(amount)).cast("double")


def sla_compliance(tickets: DataFrame) -> DataFrame:
    return tickets.filter(in_ticket_window(tickets)).agg(
        _percent(~F.col("sla_breached")).alias("sla_compliance")
    )


def kpis(wide: DataFrame, tickets: DataFrame) -> DataFrame:
    """All KPIs as rows (kpi, label, value), from one pass over each table."""
    values = wide.agg(
        _gbp(F.col("monthly_revenue_gbp")).alias("monthly_recurring_revenue"),
        _gbp(F.col("overdue_gbp")).alias("overdue_debt"),
        F.count_if(_at_risk()).cast("double").alias("at_risk_accounts"),
        _gbp(F.when(_at_risk(), F.col("monthly_revenue_gbp"))).alias("revenue_at_risk"),
        F.round(F.avg("avg_csat"), 2).alias("avg_csat"),
    ).withColumn("sla_compliance", sla_compliance(tickets).scalar())
    rows = [
        F.struct(F.lit(k).alias("kpi"), F.lit(label).alias("label"), F.col(k).alias("value"))
        for k, label in KPI_LABELS.items()
    ]
    return values.select(F.inline(F.array(*rows)))


def kpi_display(kpi_rows: DataFrame) -> DataFrame:
    """KPIs as shown to people: the unit moves from the label to the value."""
    value = F.col("value")
    shown = (
        F.when(value.isNull(), F.lit(NO_VALUE))
        .when(F.contains("label", F.lit("£")), F.concat(F.lit("£"), F.format_number(value, 0)))
        .when(F.col("kpi").isin(*COUNTS), F.format_number(value, 0))
        .otherwise(F.format_number(value, 1))
    )
    label = F.replace(
        F.replace(F.col("label"), F.lit(" (£)"), F.lit("")), F.lit(" (£ / month)"), F.lit(" / month")
    )
    return kpi_rows.select("kpi", label.alias("label"), shown.alias("shown"))


def revenue_trend(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy(F.col("issued_date").alias("month"), "product")
        .agg(_gbp(F.col("amount_gbp")).alias("revenue_gbp"))
        .orderBy(F.asc_nulls_last("month"), F.asc_nulls_last("product"))
    )


def tickets_by_category(tickets: DataFrame) -> DataFrame:
    return (
        tickets.groupBy("category")
        .agg(F.count("*").alias("tickets"), _percent(F.col("sla_breached")).alias("breach_rate_pct"))
        .orderBy(F.desc("tickets"), "category")
    )


def health_by_sector(wide: DataFrame) -> DataFrame:
    return (
        wide.groupBy("sector")
        .agg(
            F.count("*").alias("accounts"),
            F.round(F.avg("health_score"), 1).alias("avg_health"),
            _gbp(F.col("monthly_revenue_gbp")).alias("mrr_gbp"),
        )
        .orderBy(F.asc_nulls_last("avg_health"), "sector")
    )


def account_manager_portfolio(wide: DataFrame) -> DataFrame:
    return (
        wide.groupBy("account_manager")
        .agg(
            F.count("*").alias("accounts"),
            _gbp(F.col("monthly_revenue_gbp")).alias("mrr_gbp"),
            F.count_if(_at_risk()).alias("at_risk"),
        )
        .orderBy(F.desc_nulls_last("mrr_gbp"), "account_manager")
    )


def at_risk_accounts(wide: DataFrame) -> DataFrame:
    return (
        wide.filter(_at_risk())
        .orderBy(F.desc_nulls_last("monthly_revenue_gbp"), "customer_id")
        .select(
            "customer_id",
            "company_name",
            "sector",
            "account_manager",
            F.round("health_score").alias("health"),
            F.round("monthly_revenue_gbp").alias("mrr_gbp"),
            "sla_breaches_90d",
            F.round("overdue_gbp").alias("overdue_gbp"),
            "outage_minutes_3m",
        )
    )


# Report views by name: the table each reads, and the report over it.
VIEWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "revenue_trend": ("fact_invoice", revenue_trend),
    "tickets_by_category": ("fact_ticket", tickets_by_category),
    "health_by_sector": ("customer_360", health_by_sector),
    "account_manager_portfolio": ("customer_360", account_manager_portfolio),
    "at_risk_accounts": ("customer_360", at_risk_accounts),
}


# --- Saved business questions -----------------------------------------------

TOP = 10


def top_at_risk(wide: DataFrame) -> DataFrame:
    return (
        wide.filter(_at_risk())
        .orderBy(F.desc_nulls_last("monthly_revenue_gbp"), "customer_id")
        .limit(TOP)
        .select(
            "company_name",
            "account_manager",
            F.round("health_score").alias("health"),
            F.round("monthly_revenue_gbp").alias("mrr_gbp"),
        )
    )


def top_debtors(wide: DataFrame) -> DataFrame:
    return (
        wide.filter(F.col("overdue_gbp") > 0)
        .orderBy(F.desc("overdue_gbp"), "customer_id")
        .limit(TOP)
        .select("company_name", "account_manager", F.round("overdue_gbp").alias("overdue_gbp"))
    )


def breach_rate_by_category(tickets: DataFrame) -> DataFrame:
    return (
        tickets.groupBy("category")
        .agg(F.count("*").alias("tickets"), _percent(F.col("sla_breached")).alias("breach_pct"))
        .orderBy(F.desc_nulls_last("breach_pct"), "category")
    )


def mrr_by_product(invoices: DataFrame) -> DataFrame:
    return (
        invoices.filter(F.col("issued_date") == latest(invoices, "issued_date"))
        .groupBy("product")
        .agg(_gbp(F.col("amount_gbp")).alias("mrr_gbp"))
        .orderBy(F.desc_nulls_last("mrr_gbp"), "product")
    )
