"""Every registered query gives what its DuckDB SQL gives."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from checks import oracle
from checks import queries as registered
from checks.compare import connect, difference

QUERIES, SQL = registered.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, small, duck, name):
    rows, problem = difference(QUERIES[name](spark, small), duck, SQL[name])
    assert not problem
    assert rows or name == "rule_upsell_growth"  # nobody qualifies in the smallest tables


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns[0] == "customer_id" and frame.columns[-1] == "health_score"
    assert not frame.isEmpty()
