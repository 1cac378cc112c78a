"""Bands: limits belong to one side, tables change by day, faulty ones are refused."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.bands import parse_bands
from tallyhouse.plans import policies
from tallyhouse.sources.config import load_bands

OLD, NEW = date(2020, 1, 1), date(2024, 1, 1)


def bands(closed="lower", *rows, more=()):
    tables = [{"valid_from": OLD, "rows": list(rows)}, *more]
    return {"value": "x", "closed": closed, "tables": tables}


THREE = ({"to": 10, "is": "a"}, {"from": 10, "to": 20, "is": "b"}, {"from": 20, "is": "c"})
TWO = {"valid_from": NEW, "rows": [{"to": 15, "is": "new a"}, {"from": 15, "is": "new b"}]}
VALUES = [None, float("nan"), -1e300, 9.999, 10.0, 10.001, 15.0, 19.999, 20.0, 1e300]
DAYS = [None, date(2019, 12, 31), OLD, date(2023, 12, 31), NEW, date(2030, 1, 1)]


@pytest.mark.parametrize("closed", ["lower", "upper"])
def test_column_and_single_look_up_agree(spark, closed):
    table = parse_bands("test", bands(closed, *THREE, more=[TWO]))
    rows = [(v, d) for v in VALUES for d in DAYS]
    frame = spark.createDataFrame(rows, "x double, day date")
    found = frame.select("x", "day", table.outcome(F.col("x"), F.col("day")).alias("then"), table.outcome(F.col("x")).alias("now")).collect()
    for r in found:
        assert r.now == table.of(r.x)
        assert r.then == (None if r.day is None else table.of(r.x, r.day))
    assert table.of(10, OLD) == ("b" if closed == "lower" else "a") and table.of(20, OLD) == ("c" if closed == "lower" else "b")
    assert table.of(15, NEW) == ("new b" if closed == "lower" else "new a")


def test_many_bands_by_few_comparisons(spark):
    rows = [{"to": 0, "is": "0"}, *({"from": i, "to": i + 1, "is": str(i + 1)} for i in range(199)), {"from": 199, "is": "200"}]
    table = parse_bands("test", bands("lower", *rows))
    frame = spark.range(-3, 203).withColumn("found", table.outcome(F.col("id")))
    assert [r.found for r in frame.orderBy("id").collect()] == [str(min(200, max(0, i + 1))) for i in range(-3, 203)]


@pytest.mark.parametrize(
    "config, problem",
    [
        (bands("lower", {"to": 10, "is": "a"}, {"from": 11, "is": "b"}), "gap"),
        (bands("lower", {"to": 10, "is": "a"}, {"from": 9, "is": "b"}), "overlap"),
        (bands("lower", {"to": 10, "is": "a"}, {"from": 10, "to": 10, "is": "b"}, {"from": 10, "is": "c"}), "empty"),
        (bands("lower", {"from": 0, "is": "a"}), "no end"),
        (bands("lower"), "no end"),
        (bands("both", *THREE), "closed"),
        (bands("lower", *THREE, more=[TWO | {"valid_from": OLD}]), "ascending"),
    ],
)
def test_faulty_bands_are_refused(config, problem):
    with pytest.raises(ValueError, match=problem):
        parse_bands("test", config)


def test_the_limits_of_the_policies():
    found = load_bands()
    assert [found["health_band"].of(x) for x in (39.99, 40, 69.99, 70)] == ["high risk", "watch", "watch", "healthy"]
    assert [found["overdue_stage"].of(x) for x in (30, 31, 44, 45, 60, 89, 90)] == [
        "not due", "reminder", "reminder", "phone call", "formal letter", "formal letter", "finance director",
    ]
    assert [found["credit_hold"].of(x) for x in (5000, 5000.01)] == ["no", "yes"]
    assert [found["service_credit"].of(x) for x in (2, 3, 4, 5)] == ["0", "5", "5", "10"]


def test_a_ticket_open_beyond_its_target_is_a_breach(spark):
    rows = [("a", "2024-01-02 00:00:00", None, 4), ("b", "2024-01-01 20:00:00", None, 4), ("c", "2024-01-01 19:59:59", None, 4), ("d", "2024-01-01 00:00:00", "2024-01-03 00:00:00", 4), ("e", "2023-01-01 00:00:00", None, None)]
    tickets = spark.createDataFrame(rows, "customer_id string, opened string, resolved string, sla_hours int").select(
        "customer_id", F.col("opened").cast("timestamp_ntz").alias("opened_at"), F.col("resolved").cast("timestamp_ntz").alias("resolved_at"), "sla_hours"
    )
    assert [tuple(r) for r in policies.open_breaches(tickets).collect()] == [("c", 1)]
