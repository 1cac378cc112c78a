from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.ingest import ingest
from tallyhouse.sources import files
from tallyhouse.sources.config import load_sources
from tallyhouse.sources.store import Store, shared_folder
from tests.sample import write_extracts


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = write_extracts(tmp_path_factory.mktemp("extracts"))
    return files.read_sources(spark, folder, load_sources())


@pytest.fixture(scope="module", params=["lazy", "stored"])
def ingested(spark, raw, request):
    return ingest(raw, load_sources(), Store.fresh(spark, "test") if request.param == "stored" else None)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_quoted_fields_and_empty_text(raw):
    companies = [r.Company for r in raw["crm"].orderBy("Account ID").collect()]
    assert companies == ["Acme, Ltd", 'Bolt "B" & Co', "Cog plc"]
    assert raw["billing"].filter(F.col("paid_on") == "").count() == 4


def test_every_issue_is_reported(ingested):
    assert rows(ingested.quality_report()) == [
        ("billing", "I4", "amount_gbp", "could not parse as currency"),
        ("billing", "I6", "amount_gbp", "could not parse as currency"),
        ("billing", "I6", "cust_ref", "unrecognised customer key"),
        ("billing", "I6", "issued_date", "could not parse as date"),
        ("invoice", "I5", "customer_id", "no matching CRM account (quarantined)"),
        ("network", "NB/0003|2024-04", "voice_minutes", "could not parse as int"),
        ("servicedesk", "6", "client", "unrecognised customer key"),
    ]


def test_lineage_counts(ingested):
    counts = {r.entity: (r.rows_in, r.rows_loaded, r.pii_fields) for r in ingested.lineage().collect()}
    assert counts == {
        "customer": (3, 3, ["contact_email"]),
        "invoice": (6, 4, []),
        "ticket": (6, 5, ["summary"]),
        "usage": (6, 6, []),
    }


def test_rows_with_bad_values_stay_and_orphans_go(ingested):
    invoices = {r.invoice_id: r for r in ingested.frame("invoice").collect()}
    assert sorted(invoices) == ["I1", "I2", "I3", "I4"]
    assert invoices["I1"].amount_gbp == 1204.0 and invoices["I1"].paid_date is None
    assert invoices["I4"].amount_gbp is None
    assert [r.invoice_id for r in ingested.orphans("invoice").collect()] == ["I5"]


def test_transforms_and_pii(ingested, request):
    customers = ingested.frame("customer").orderBy("customer_id").collect()
    assert [c.sector for c in customers] == ["Retail", "Health Care", "Energy"]
    stored = request.node.callspec.params["ingested"] == "stored"
    assert ("contact_email" in ingested.frame("customer").columns) == (not stored)
    assert ("summary" in ingested.frame("ticket").columns) == (not stored)
    assert "contact_email" not in ingested.without_pii("customer").columns
    assert "summary" not in ingested.without_pii("ticket").columns


def test_missing_column_is_an_error(raw):
    with pytest.raises(ValueError, match="billing lacks.*net_amount"):
        ingest(raw | {"billing": raw["billing"].drop("net_amount")}, load_sources())


def test_unknown_format_is_an_error(spark):
    with pytest.raises(ValueError, match="Unsupported format"):
        files.read_source(spark, "/nowhere", {"file": "x", "format": "xml", "fields": {}})


def test_records_over_several_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('id,note\n1,"two\nlines, ""quoted"""\n2,one\n', encoding="utf-8")
    source = {"file": "notes.csv", "format": "csv"}
    got = files.read_source(spark, str(tmp_path), source)
    assert got.columns == ["id", "note", files.MALFORMED]
    assert rows(got) == [("1", 'two\nlines, "quoted"', None), ("2", "one", None)]


def test_lines_of_another_length_are_issues(spark, tmp_path):
    source = load_sources()["network"]
    lines = [",".join(source["fields"]), "NB/1,2024-01,1,2,3", "NB/2,2024-01,1,2,3,surplus,more", "NB/3,2024-01,1"]
    (tmp_path / source["file"]).write_text("\n".join(lines) + "\n", encoding="utf-8")
    crm = spark.createDataFrame([("C-1",), ("C-2",), ("C-3",)], "`Account ID` string")
    mapping = {"crm": {"file": "", "entity": "customer", "fields": {"Account ID": "customer_id"},
                       "key": load_sources()["crm"]["key"]}, "network": source}
    result = ingest({"crm": crm, "network": files.read_source(spark, str(tmp_path), source)}, mapping)
    issues = rows(result.quality_report().select("row", "field", "problem"))
    assert issues == [(f"NB/{n}|2024-01", "line", "wrong number of fields") for n in (2, 3)]
    assert result.frame("usage").count() == 3


def test_only_customers(spark, raw):
    mapping = {"crm": load_sources()["crm"]}
    result = ingest({"crm": raw["crm"]}, mapping, Store.fresh(spark, "alone"))
    assert result.frame("customer").count() == 3 and result.quality_report().isEmpty()


def test_a_folder_of_extracts_reads_as_one(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for n in range(3):
        (tmp_path / "parts" / f"{n}.csv").write_text(f"id,v\n{n},a\n", encoding="utf-8")
    got = files.read_source(spark, str(tmp_path), {"file": "parts", "format": "csv"})
    assert [r[0] for r in rows(got)] == ["0", "1", "2"]


def test_json_lines_layout(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 7, "b": "x"}\n{"a": "u"}\n', encoding="utf-8")
    source = {"file": "t.json", "format": "json", "layout": "lines", "fields": {"a": "a", "b": "b"}}
    assert {tuple(r) for r in files.read_source(spark, str(tmp_path), source).collect()} == {("7", "x"), ("u", None)}


def test_a_customer_with_a_third_of_all_rows_and_many_bad_keys(spark):
    """Results stay whole when one key, and unreadable keys, make up most of the rows."""
    n = 30_000
    number = F.when(F.col("id") % 3 == 0, F.lit("7")).when(F.col("id") % 3 == 1, F.lit("oops"))
    usage = spark.range(n).select(
        F.concat(F.lit("NB/"), number.otherwise((F.col("id") % 100).cast("string"))).alias("acct"),
        F.lit("2024-01").alias("period"),
        F.lit("1").alias("voice_minutes"),
        F.lit("1").alias("data_gb"),
        F.lit("1").alias("outage_minutes"),
    )
    crm = spark.range(50).select(
        F.format_string("C-%04d", "id").alias("Account ID"),
        *(F.lit("1").alias(c) for c in ("Company", "Sector", "Town", "Primary Contact Email")),
        F.lit("x").alias("Account Manager"),
        F.lit("01/01/2020").alias("Customer Since"),
        F.lit("1").alias("Seats"),
    )
    mapping = {k: v for k, v in load_sources().items() if k in ("crm", "network")}
    result = ingest({"crm": crm, "network": usage}, mapping, Store.fresh(spark, "skew"))
    line = next(r for r in result.lineage().collect() if r.entity == "usage")
    orphans = sum(1 for i in range(n) if i % 3 == 2 and i % 100 >= 50)
    assert (line.rows_in, line.rows_loaded) == (n, n - n // 3 - orphans)
    assert result.quality_report().count() == n // 3 + orphans


def test_many_unknown_keys_are_joined_by_shuffle(spark, raw, ingested, monkeypatch):
    monkeypatch.setattr("tallyhouse.operators.ingest.BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = ingest(raw, load_sources(), Store.fresh(spark, "shuffle"))
        assert rows(again.quality_report()) == rows(ingested.quality_report())
        assert rows(again.frame("invoice")) == rows(ingested.frame("invoice"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_counts_taken_while_writing(spark, small, monkeypatch):
    """Lineage and issue counts are those of a scan, and read nothing."""
    from checks.extracts import extracts
    from tallyhouse.operators import ingest as ingesting

    counted = ingest(extracts(spark, small, dirty=True), load_sources(), Store.fresh(spark, "counts"))
    lineage, issues = counted.lineage(), counted.issue_counts()
    for frame in (lineage, issues):
        assert "FileScan" not in frame._jdf.queryExecution().executedPlan().toString()
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    scanned = counted.quality_report().groupBy("source", "field", "problem").count()
    assert rows(issues) == rows(scanned) != []
    for source in counted.sources.values():
        source.counts = None
    assert rows(counted.lineage()) == rows(lineage) and rows(counted.issue_counts()) == rows(scanned)
    assert ingesting.possible_issues(load_sources()["crm"])[0] == ("line", ingesting.BAD_LINE)


@pytest.mark.parametrize("layout", ["lines", None])
def test_a_field_that_no_json_record_has_is_an_error(spark, tmp_path, layout):
    """A field that is null in all records that have it, or that only the last record has, is none."""
    records = [{"a": 1, "n": None} for _ in range(3000)] + [{"a": 2, "last": "x"}]
    text = "\n".join(json.dumps(r) for r in records) if layout else json.dumps(records)
    (tmp_path / "t.json").write_text(text, encoding="utf-8")
    source = {"file": "t.json", "format": "json", "layout": layout, "fields": {"a": "a", "n": "n", "last": "last"}}
    rows = files.read_source(spark, str(tmp_path), source)
    assert rows.filter("last IS NOT NULL").count() == 1 and rows.filter("n IS NULL").count() == 3001
    with pytest.raises(ValueError, match="absent"):
        files.read_source(spark, str(tmp_path), source | {"fields": {"a": "a", "absent": "b"}})
