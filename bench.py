"""Time the headline queries and print one JSON line.

Each query is planned, run and written to Spark's no-op sink, so nothing is cut short by a limit
on collected rows. ``build_marts`` is the whole way from raw extracts to customer_360.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as registered  # noqa: E402
from tallyhouse.session import build_session  # noqa: E402

HEADLINE = (
    "ingest_invoice",
    "quality_report",
    "customer_360",
    "customer_360_by_month",
    "kpis",
    "revenue_trend",
    "tickets_by_category",
    "account_manager_portfolio",
    "at_risk_accounts",
    "open_actions",
    "actions_second_run",
    "redact_documents",
    "token_counts",
    "term_frequencies",
    "bm25_term_stats",
    "bm25_search",
    "passage_search",
    "chunk_documents",
    "intent_classify",
    "question_policy",
    "governed_query",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds: dict[str, float] = {}

    def timed(name: str, job) -> None:
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("build_marts", lambda: registered.marts(spark, folder))
    timed("build_ingest", lambda: registered.dirty_ingest(spark, folder))
    timed("build_monthly", lambda: registered.monthly(spark, folder))
    timed("build_passage_index", lambda: registered.passage_index(spark, folder))
    every = registered.queries()
    for name in HEADLINE:
        timed(name, lambda: every[name](spark, folder).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
