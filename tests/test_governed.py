from __future__ import annotations

import json

import pytest

from checks import queries as registered
from tallyhouse.operators.governed import FailedQuery, GovernedSession, UnsafeQuery
from tallyhouse.plans.marts import TABLES
from tallyhouse.sources.audit import AuditLog


@pytest.fixture(scope="module")
def paths(spark, small):
    store = registered.marts(spark, small).store
    return {name: store.path(name) for name in TABLES}


@pytest.fixture(scope="module")
def governed(spark, paths):
    return GovernedSession(spark, paths)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE fact_usage",
        "DELETE FROM fact_ticket",
        "INSERT INTO fact_ticket SELECT * FROM fact_ticket",
        "CREATE TABLE x AS SELECT 1",
        "SET spark.sql.runSQLOnFiles=true",
        "SELECT 1 AS a; SELECT 2 AS a",
        "SELECT 1 AS a; DROP TABLE fact_usage",
        "SELECT 1 AS a) AS q; DROP TABLE fact_usage --",
        "SELECT * FROM fact_usage) AS q CROSS JOIN (SELECT 1 AS a",
        "SELECT * FROM fact_usage) AS q /*",
        "SELECT * FROM workflow_actions",
        "SELECT * FROM read_csv('secrets.csv')",
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT * FROM text.`/etc/passwd`",
        "COPY fact_usage TO 'out.csv'",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS a",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') AS a",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.Math', 'abs', -3) AS a",
        "SELECT try_reflect('java.lang.Math', 'abs', -3) AS a FROM fact_usage",
        "SELECT 1 AS a WHERE EXISTS (SELECT java_method('java.lang.Math', 'abs', -3))",
        "SELECT TRANSFORM(customer_id) USING 'cat' AS (x STRING) FROM dim_customer",
        "WITH t AS (SELECT TRANSFORM(town) USING 'cat' AS (x STRING) FROM dim_customer) SELECT * FROM t",
        "FROM dim_customer MAP customer_id USING 'cat' AS x",
        "SELECT * FROM range(5)",
        "SHOW TABLES",
        "EXPLAIN SELECT 1 AS a",
        "",
    ],
)
def test_unsafe_queries_are_refused(governed, sql):
    with pytest.raises(UnsafeQuery):
        governed.query(sql)


def test_file_tables_are_refused_even_where_the_file_exists(governed, paths):
    with pytest.raises(UnsafeQuery):
        governed.query(f"SELECT * FROM parquet.`{paths['fact_usage']}`")


def test_saved_tables_outside_the_list_are_refused(spark, governed, tmp_path):
    spark.range(3).write.option("path", str(tmp_path / "t")).saveAsTable("salaries")
    try:
        for name in ("salaries", "default.salaries", "spark_catalog.default.salaries"):
            with pytest.raises(UnsafeQuery):
                governed.query(f"SELECT * FROM {name}")
    finally:
        spark.sql("DROP TABLE salaries")


def test_views_of_other_sessions_are_out_of_reach(spark, governed):
    spark.range(3).createOrReplaceTempView("mine")
    with pytest.raises(UnsafeQuery):
        governed.query("SELECT * FROM mine")


@pytest.mark.parametrize(
    "sql",
    [
        "WITH x AS (SELECT * FROM customer_360) SELECT company_name FROM x;",
        "SELECT town FROM dim_customer UNION SELECT sector FROM dim_customer",
        "SELECT company_name FROM dim_customer -- all of them",
        "SELECT 'DROP TABLE x; --' AS a FROM fact_usage",
        "SELECT town, 'SubqueryAlias a.b' AS a FROM dim_customer WHERE customer_id <> 'reflect'",
        "SELECT customer_id, rank() OVER (ORDER BY seats) AS r FROM dim_customer ORDER BY r OFFSET 1",
        "SELECT count_if(sla_breached) AS n, to_json(struct(max(opened_at))) AS j FROM fact_ticket GROUP BY CUBE(priority)",
        "SELECT x FROM dim_customer LATERAL VIEW explode(split(town, ' ')) AS x WHERE seats >= (SELECT min(seats) FROM dim_customer)",
    ],
)
def test_selects_run_and_are_capped(governed, sql):
    assert governed.guard(sql).endswith("LIMIT 500")
    assert not governed.query(sql).isEmpty()


def test_row_cap(governed):
    everything = "SELECT a.customer_id FROM fact_invoice a JOIN fact_invoice b USING (customer_id)"
    assert governed.query(everything).count() == 500


def test_records_and_audit(spark, paths, tmp_path):
    audit = AuditLog(spark, str(tmp_path / "audit"))
    governed = GovernedSession(spark, paths, audit)
    records = governed.run(
        "SELECT opened_at, resolved_at, 1.23456D AS x FROM fact_ticket ORDER BY resolved_at DESC", "look"
    )
    assert len(records) == 50
    first = json.loads(records[-1])
    assert first["x"] == 1.23 and len(first["opened_at"]) == 23
    with pytest.raises(UnsafeQuery):
        governed.run("DROP TABLE fact_usage")
    events = {r.event: r.detail for r in audit.entries().collect()}
    assert events["sql_run"]["purpose"] == "look" and int(events["sql_run"]["rows"]) > 50
    assert "DROP" in events["sql_blocked"]["sql"]
    with pytest.raises(FailedQuery):
        governed.run("SELECT raise_error('no such luck') AS a FROM fact_usage")
    failed = audit.entries().filter("event = 'sql_failed'").collect()
    assert len(failed) == 1 and "no such luck" in failed[0].detail["reason"]


def test_only_marts_can_be_approved(spark):
    with pytest.raises(ValueError, match="salaries"):
        GovernedSession(spark, {"salaries": "/tmp/x"})
