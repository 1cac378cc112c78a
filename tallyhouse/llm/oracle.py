"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {}
