"""Ingest, marts and rules end to end.

    python -m tallyhouse.plans.pipeline EXTRACTS OUTPUT
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.actions import ActionLog
from tallyhouse.operators.ingest import IngestResult, ingest
from tallyhouse.plans.marts import Marts
from tallyhouse.session import build_session
from tallyhouse.sources.audit import AuditLog
from tallyhouse.sources.config import load_rules, load_sources
from tallyhouse.sources.files import read_sources
from tallyhouse.sources.store import Store


@dataclass
class Run:
    ingested: IngestResult
    marts: Marts
    audit: AuditLog
    actions: DataFrame


def run(
    spark: SparkSession,
    extracts: str,
    output: str,
    mapping: dict[str, dict] | None = None,
    rules: list[dict] | None = None,
) -> Run:
    """Read the extracts, rebuild the marts below ``output``, raise what the rules find.

    The action and audit logs below ``output`` carry on from earlier runs.
    """
    mapping = load_sources() if mapping is None else mapping
    store = Store(spark, f"{output}/tables")
    audit = AuditLog(spark, f"{output}/audit")
    ingested = ingest(read_sources(spark, extracts, mapping), mapping, store)
    audit.record_rows(
        ingested.lineage(),
        "ingestion",
        F.concat(F.lit("load:"), F.col("entity")),
        {"rows_in": F.col("rows_in"), "rows_loaded": F.col("rows_loaded")},
    )
    audit.record("ingestion", "quality", {"quality_issues": ingested.quality_report().count()})
    marts = Marts(ingested, store).build()
    marts.register()
    log = ActionLog(spark, f"{output}/actions")
    return Run(ingested, marts, audit, log.run_rules(load_rules() if rules is None else rules, audit))


def main(extracts: str, output: str) -> None:
    result = run(build_session(), extracts, output)
    result.ingested.lineage().show(truncate=False)
    result.ingested.quality_report().groupBy("source", "field", "problem").count().show(truncate=False)
    result.actions.groupBy("rule_name").count().show(truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:3])
