"""Marts kept by month: deliveries, versions, and customer_360 beside a whole rebuild."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from checks.extracts import extracts
from tallyhouse.operators.ingest import ingest
from tallyhouse.plans.monthly import FACTS, MonthlyMarts
from tallyhouse.sources.config import load_sources
from tallyhouse.sources.store import Store


@pytest.fixture(scope="module")
def frames(spark, small):
    store = Store.fresh(spark, "monthly")
    result = ingest(extracts(spark, small), load_sources(), store)
    return {entity: result.without_pii(entity) for entity in ("customer", "invoice", "ticket", "usage")}


def month_of(frame, entity):
    moment = next(column for column, e in FACTS.values() if e == entity)
    return F.date_format(F.col(moment), "yyyy-MM")


def months_of(frame, entity) -> list[str]:
    return sorted(r[0] for r in frame.select(month_of(frame, entity)).distinct().collect())


def rows(frame, *but):
    columns = sorted(c for c in frame.columns if c not in but)
    return sorted(registered.plain(frame.select(*columns)).collect(), key=str)


def spoilt(frame, entity, month):
    """The month as first delivered: some rows lacking, numbers wrong."""
    wrong = {"invoice": "amount_gbp", "ticket": "csat_score", "usage": "data_gb"}[entity]
    here = month_of(frame, entity) == month
    first = frame.filter(~here | (F.xxhash64(*frame.columns) % 3 != 0))
    return first.withColumn(wrong, F.when(here, F.col(wrong) + 1).otherwise(F.col(wrong)).cast(frame.schema[wrong].dataType))


@pytest.fixture(scope="module")
def delivered(spark, frames):
    """Most months with a spoilt one among them, then the last months with that one set right."""
    place, first, second, changed = Store.fresh(spark, "monthly").folder, {"customer": frames["customer"]}, {}, {}
    for name, (_, entity) in FACTS.items():
        months = months_of(frames[entity], entity)
        old, last = months[len(months) // 2], months[-1]
        here = month_of(frames[entity], entity)
        first[entity] = spoilt(frames[entity], entity, old).filter(here < last)
        second[entity] = frames[entity].filter(here.isin(old, last))
        changed[name] = {old, last}
    before = MonthlyMarts.open(spark, place).deliver(first)
    return before, MonthlyMarts.open(spark, place).deliver(second), changed


@pytest.mark.parametrize("name", ["dim_customer", "fact_invoice", "fact_ticket", "fact_usage", "customer_360"])
def test_equal_to_a_rebuild(spark, small, delivered, name):
    _, after, _ = delivered
    assert rows(after.table(name), "of_month") == rows(registered.marts(spark, small).table(name))


def test_only_changed_months_are_read(delivered):
    """And the one in which the ticket window begins."""
    _, after, changed = delivered
    for name, months in changed.items():
        more = set(after.months_read[name]) - months
        assert months <= set(after.months_read[name]) and len(more) <= (1 if name == "fact_ticket" else 0)
    assert any(len(after.months(name)) > 4 for name in changed)


def test_old_months_stay_where_they_are(delivered):
    before, after, changed = delivered
    for name, months in changed.items():
        old, new = before.version.content["months"][name], after.version.content["months"][name]
        assert {m for m in old if new[m] == old[m]} == set(old) - months


def test_a_reader_keeps_its_version(spark, frames, delivered):
    """During a delivery and after it, an open version shows what it showed."""
    before, after, _ = delivered
    place = Store.fresh(spark, "monthly").folder
    one = MonthlyMarts.open(spark, place).deliver(frames)
    shown = rows(one.table("customer_360"))
    seen = []
    writer = MonthlyMarts.open(spark, place)
    commit = writer.versions.commit

    def watched(now, content):  # everything is written, nothing committed yet
        seen.append(rows(MonthlyMarts.open(spark, place).table("customer_360")))
        return commit(now, content)

    writer.versions.commit = watched
    two = writer.deliver({"customer": frames["customer"].limit(10)})
    assert seen == [shown] and rows(one.table("customer_360")) == shown
    assert two.table("customer_360").count() == 10 and MonthlyMarts.open(spark, place).version.number == 2


def test_two_deliveries_at_once_both_count(spark, frames):
    """The one that comes second is put on top of the other; neither loses its months."""
    place = Store.fresh(spark, "monthly").folder
    MonthlyMarts.open(spark, place).deliver(frames)
    one, two = MonthlyMarts.open(spark, place), MonthlyMarts.open(spark, place)
    invoices, months = frames["invoice"], months_of(frames["invoice"], "invoice")
    part = lambda month: {"invoice": invoices.filter(month_of(invoices, "invoice") == month).withColumn("amount_gbp", F.lit(1.0))}
    write = one._write_months

    def slowly(*args):
        found = write(*args)
        two.deliver(part(months[1]))
        return found

    one._write_months = slowly
    last = one.deliver(part(months[0]))
    ones = last.table("fact_invoice").filter("amount_gbp = 1.0").select(F.date_format("issued_date", "yyyy-MM")).distinct()
    assert {months[0], months[1]} <= {r[0] for r in ones.collect()} and last.version.number == 3


def test_a_report_of_some_days_reads_their_months(delivered):
    _, after, _ = delivered
    first, last = date(2000, 1, 1), date(2000, 6, 30)
    found = after.between("fact_invoice", first, last)
    files = found.inputFiles()
    assert files and {f.split("of_month=")[1][:7] for f in files} <= {f"2000-{m:02d}" for m in range(1, 7)}
    whole = after.table("fact_invoice")
    assert rows(found) == rows(whole.filter(F.col("issued_date").between(F.lit(first), F.lit(last))))
    assert len(files) < len(whole.inputFiles())


def test_months_are_pruned_by_what_they_are_joined_with(spark, delivered):
    """A filter on a table of months reaches the files of the fact while the query runs."""
    _, after, _ = delivered
    some = spark.createDataFrame([(m, f"Q{m[5:]}") for m in after.months("fact_usage")], "of_month string, quarter string")
    plan = after.table("fact_usage").join(F.broadcast(some.filter("quarter = 'Q04'")), "of_month")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_rows_without_a_date(spark, frames):
    """They are kept, and count for nothing that hangs on a date."""
    undated = frames["ticket"].limit(3).withColumn("opened_at", F.lit(None).cast("timestamp_ntz"))
    place = Store.fresh(spark, "monthly").folder
    made = MonthlyMarts.open(spark, place).deliver(frames | {"ticket": frames["ticket"].unionByName(undated)})
    plain = MonthlyMarts.open(spark, Store.fresh(spark, "monthly").folder).deliver(frames)
    assert made.table("fact_ticket").count() == plain.table("fact_ticket").count() + 3
    assert rows(made.table("customer_360")) == rows(plain.table("customer_360"))


def test_nothing_delivered(spark, frames):
    empty = {entity: frame.limit(0) for entity, frame in frames.items()}
    made = MonthlyMarts.open(spark, Store.fresh(spark, "monthly").folder).deliver(empty | {"customer": frames["customer"]})
    assert made.table("fact_invoice").collect() == [] and made.table("customer_360").count() == frames["customer"].count()
