"""Run every registered query beside its DuckDB SQL and report differences.

    python -m checks.compare [FOLDER] [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def _cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) + 0.0 if isinstance(value, (int, float)) else value


def _rows(rows, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str]:
    """Row count of a Spark result, and what is different from the SQL's result, if anything."""
    got = _rows((tuple(r) for r in frame.collect()), frame.columns)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = _rows(result.fetchall(), columns)
    if sorted(columns) != sorted(frame.columns):
        return got.total(), f"columns {sorted(frame.columns)} but SQL gives {sorted(columns)}"
    if got != want:
        extra, lacking = got - want, want - got
        return got.total(), (
            f"{extra.total()} rows too many, {lacking.total()} lacking of {want.total()}; "
            f"got {list(extra)[:2]} want {list(lacking)[:2]}"
        )
    return got.total(), ""


def main(folder: str, names: list[str]) -> int:
    from checks.oracle import oracle_sql
    from checks.queries import queries
    from tallyhouse.session import build_session

    spark = build_session(
        master="local[8]", extra={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            rows, problem = difference(query(spark, folder), con, sql[name])
        except Exception as error:  # report and go on with the next query
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {rows:>7} rows {time.time() - start:6.2f}s {problem}")
    print(f"{failed} failed; without SQL: {sorted(set(queries()) - set(sql))}; SQL only: {sorted(set(sql) - set(queries()))}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
