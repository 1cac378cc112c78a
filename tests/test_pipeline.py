from __future__ import annotations

import pyarrow.parquet as pq

from tallyhouse.plans import pipeline
from tests.sample import BILLING, write_extracts


def test_two_runs_over_changing_extracts(spark, tmp_path):
    extracts, output = write_extracts(tmp_path / "in"), str(tmp_path / "out")
    first = pipeline.run(spark, extracts, output)
    assert first.ingested.quality_report().count() == 7
    acme = {("Overdue invoices", "C-0001"), ("Growth opportunity", "C-0001")}
    before = {(r.rule_name, r.customer_id): r.raised_at for r in first.actions.collect()}
    assert set(before) == acme

    # Bolt now owes for three months as well; Acme's open actions stay the ones they were.
    more = BILLING + "I7,CUST0002,Broadband,£20.00,2024-01-01,\n"
    (tmp_path / "in" / "billing_invoices.csv").write_text(more, encoding="utf-8")
    second = pipeline.run(spark, extracts, output)
    after = {(r.rule_name, r.customer_id): r.raised_at for r in second.actions.collect()}
    assert set(after) == acme | {("Overdue invoices", "C-0002")}
    assert {key: after[key] for key in acme} == before
    assert spark.table("fact_invoice").count() == 5

    events = [r.event for r in second.audit.entries().collect()]
    assert events.count("load:invoice") == events.count("quality") == events.count("churn_risk_review") == 2


def test_no_written_file_holds_personal_data(spark, tmp_path):
    pipeline.run(spark, write_extracts(tmp_path / "in"), str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").rglob("*") if f.is_file()]
    assert len(files) > 5
    for file in files:
        if file.suffix == ".parquet":
            assert not {"contact_email", "summary"} & set(pq.read_schema(file).names), file
            content = str(pq.read_table(file).to_pylist())
        else:
            content = file.read_bytes().decode(errors="ignore")
        assert ".example" not in content and "call ann" not in content, file


def test_no_rules_raise_nothing(spark, tmp_path):
    folder = write_extracts(tmp_path / "in")
    assert pipeline.run(spark, folder, str(tmp_path / "out"), rules=[]).actions.isEmpty()
