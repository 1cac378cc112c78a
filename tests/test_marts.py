from __future__ import annotations

from datetime import date

import pytest

from checks import queries as registered
from tallyhouse.operators.ingest import ingest
from tallyhouse.plans import metrics
from tallyhouse.plans.marts import TABLES, Marts
from tallyhouse.sources import files
from tallyhouse.sources.config import load_sources
from tallyhouse.sources.store import Store
from tests.sample import write_extracts


@pytest.fixture(scope="module")
def marts(spark, tmp_path_factory):
    folder = write_extracts(tmp_path_factory.mktemp("extracts"))
    store = Store.fresh(spark, "marts")
    mapping = load_sources()
    return Marts(ingest(files.read_sources(spark, folder, mapping), mapping, store), store).build()


def by(frame, key):
    return {r[key]: r for r in frame.collect()}


def test_invoice_days(marts):
    invoices = by(marts.table("fact_invoice"), "invoice_id")
    assert (invoices["I2"].days_to_pay, invoices["I2"].days_outstanding) == (19, None)
    # As-of date: 30 days after the newest invoice of a known customer.
    assert (invoices["I1"].days_to_pay, invoices["I1"].days_outstanding) == (None, 121)
    assert invoices["I3"].days_outstanding == 30


def test_ticket_times(marts):
    tickets = by(marts.table("fact_ticket"), "ticket_id")
    assert tickets[1].resolution_hours == 241 / 60 and tickets[1].sla_breached
    assert tickets[2].resolution_hours == 4.0 and not tickets[2].sla_breached
    assert tickets[3].sla_hours is None and tickets[3].sla_breached is False
    assert tickets[4].resolution_hours is None and tickets[4].sla_breached is False
    assert tickets[5].sla_breached


def test_customer_360(marts):
    wide = by(marts.table("customer_360"), "customer_id")
    one = wide["C-0001"]
    assert (one.monthly_revenue_gbp, one.product_count, one.overdue_gbp) == (300.5, 1, 1204.0)
    assert (one.tickets_90d, one.sla_breaches_90d, one.avg_csat) == (3, 1, 3.5)
    # Months after January (March, April and February); the empty outage counts as nothing.
    assert one.outage_minutes_3m == 25
    assert one.data_growth_pct == pytest.approx(20.0)
    assert one.health_score == pytest.approx(100 - 6 - 1204 / 250 - 25 / 20 - 9 + 20 / 3)
    two = wide["C-0002"]
    assert (two.monthly_revenue_gbp, two.tickets_90d, two.avg_csat) == (99.99, 1, None)
    three = wide["C-0003"]
    assert (three.monthly_revenue_gbp, three.product_count, three.data_growth_pct) == (0.0, 0, 0.0)
    assert three.customer_since == date(2021, 6, 15)


def test_no_personal_data_in_any_mart(marts):
    columns = {c for name in TABLES for c in marts.table(name).columns}
    assert not columns & {"contact_email", "summary"}


def test_kpis_of_no_accounts_at_risk(marts):
    shown = by(
        metrics.kpi_display(metrics.kpis(marts.table("customer_360"), marts.table("fact_ticket"))), "kpi"
    )
    assert shown["revenue_at_risk"].shown == "–"
    assert shown["revenue_at_risk"].label == "Revenue at risk / month"
    assert shown["monthly_recurring_revenue"].shown == "£400"
    assert shown["at_risk_accounts"].shown == "0"
    assert shown["sla_compliance"].shown == "75.0"


def test_whole_pounds_do_not_depend_on_the_order_of_rows(spark):
    assert 0.7 + 0.6 + 0.2 < 1.5 == 0.6 + 0.2 + 0.7
    for amounts in ([0.7, 0.6, 0.2], [0.6, 0.2, 0.7]):
        frame = spark.createDataFrame([("p", a) for a in amounts], "product string, amount_gbp double")
        trend = metrics.revenue_trend(frame.coalesce(1).selectExpr("*", "DATE'2024-01-01' AS issued_date"))
        assert trend.first().revenue_gbp == 2.0


def test_one_row_per_customer_and_bounded_score(spark, small):
    wide = registered.marts(spark, small).table("customer_360")
    n, keys, low, high = wide.selectExpr(
        "count(*)", "count(DISTINCT customer_id)", "min(health_score)", "max(health_score)"
    ).first()
    assert n == keys == spark.read.parquet(f"{small}/customer.parquet").count()
    assert 0 <= low <= high <= 100


def test_date_filters_reach_the_scan(spark, small):
    from tallyhouse.operators import rollups

    built = registered.marts(spark, small)
    plan = rollups.revenue(built.table("fact_invoice"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(issued_date,ScalarSubquery" in plan
    plan = rollups.tickets_90d(built.table("fact_ticket"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(opened_at,ScalarSubquery" in plan


@pytest.mark.parametrize("name", sorted(metrics.VIEWS))
def test_views_have_rows(spark, small, name):
    table, report = metrics.VIEWS[name]
    assert not report(registered.marts(spark, small).table(table)).isEmpty()
