from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from tallyhouse.operators import actions
from tallyhouse.operators.actions import ActionLog
from tallyhouse.sources import audit as audit_module
from tallyhouse.sources.audit import AuditLog
from tallyhouse.sources.config import load_rules

FIRST, SECOND = datetime(2024, 1, 1, 8), datetime(2024, 1, 2, 8)


@pytest.fixture(scope="module", autouse=True)
def views(spark, small):
    registered.marts(spark, small).register()


def keyed(frame):
    return {(r.rule_name, r.customer_id): r for r in frame.collect()}


def test_running_twice_raises_nothing_twice(spark, tmp_path):
    log = ActionLog(spark, str(tmp_path / "log"))
    first = keyed(log.run_rules(load_rules(), at=FIRST))
    second = keyed(log.run_rules(load_rules(), at=SECOND))
    assert first and first == second
    assert log.entries().count() == len(first)


def test_the_later_of_two_runs_at_once_counts(spark, tmp_path):
    log = ActionLog(spark, str(tmp_path / "log"))
    hits = actions.all_hits(spark, load_rules())
    for run, at in ((1, FIRST), (2, SECOND)):  # neither sees what the other raised
        log._append(actions.new_actions(hits, actions.empty_log(spark), at, run))
    work = actions.open_actions(log.entries()).collect()
    assert len(work) == len(keyed(actions.open_actions(log.entries()))) == log.entries().count() / 2 > 0
    assert {r.raised_at for r in work} == {SECOND}
    assert log._next_run() > 2


def test_two_interleaved_runs_raise_an_action_once(spark, tmp_path, monkeypatch):
    """The first run has decided what is new when the second one commits; it decides again and finds nothing."""
    one, two = ActionLog(spark, str(tmp_path / "log")), ActionLog(spark, str(tmp_path / "log"))
    write, overtaken = one._part, []

    def slowly(entries):
        part = write(entries)
        if not overtaken:
            overtaken.append(two.run_rules(load_rules(), at=SECOND).count())
        return part

    monkeypatch.setattr(one, "_part", slowly)
    work = one.run_rules(load_rules(), at=FIRST).collect()
    assert len(work) == overtaken[0] == one.entries().count() > 0
    assert {r.raised_at for r in work} == {SECOND} and one.snapshot().number == 1


def test_a_reader_keeps_its_version(spark, tmp_path):
    log = ActionLog(spark, str(tmp_path / "log"))
    before = log.snapshot()
    work = log.run_rules(load_rules(), at=FIRST)
    opened = log.snapshot()
    log.close(F.lit(True))
    log.compact()
    assert actions.open_actions(log.entries()).collect() == []
    assert log.entries(before).collect() == []
    assert keyed(actions.open_actions(log.entries(opened))) == keyed(work) != {}


def test_compaction_leaves_the_state(spark, tmp_path):
    log = ActionLog(spark, str(tmp_path / "log"))
    log.run_rules(load_rules(), at=FIRST)
    log.close(F.col("rule_id") == "churn_risk_review")
    log.run_rules(load_rules(), at=SECOND)
    entries, states = log.entries().count(), set(actions.state(log.entries()).collect())
    version = log.compact()
    assert len(version.content["parts"]) == 1 and log.entries().count() == len(states) < entries
    assert set(actions.state(log.entries()).collect()) == states
    assert log.compact().number == version.number  # nothing left to do
    again = log.run_rules(load_rules(), at=datetime(2024, 1, 3, 8))
    assert log.snapshot().number == version.number and again.count() == len(states)


def test_many_parts_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(actions, "MOST_PARTS", 3)
    log = ActionLog(spark, str(tmp_path / "log"))
    for turn in range(3):
        log.run_rules(load_rules(), at=FIRST)
        log.close(F.col("owner") == "finance")
    assert len(log.snapshot().content["parts"]) <= 3
    assert {r.status for r in actions.state(log.entries()).collect()} == {"open", "closed"}


def test_a_closed_action_opens_again(spark, tmp_path):
    log = ActionLog(spark, str(tmp_path / "log"))
    first = keyed(log.run_rules(load_rules(), at=FIRST))
    log.close(F.col("rule_id") == "churn_risk_review")
    closed = {k for k in first if k[0] == "Churn-risk account review"}
    assert closed and set(keyed(actions.open_actions(log.entries()))) == set(first) - closed
    again = keyed(ActionLog(spark, str(tmp_path / "log")).run_rules(load_rules(), at=SECOND))
    assert set(again) == set(first)
    assert {k for k, r in again.items() if r.raised_at == SECOND} == closed


def test_owners_and_order(spark, tmp_path):
    work = ActionLog(spark, str(tmp_path / "log")).run_rules(load_rules(), at=FIRST).collect()
    urgency = {"high": 0, "medium": 1, "low": 2}
    order = [(urgency[r.priority], r.rule_name, r.company_name, r.customer_id) for r in work]
    assert order == sorted(order)
    managers = {r.customer_id: r.account_manager for r in spark.table("dim_customer").collect()}
    for r in work:
        expected = {"Repeated SLA breaches": "service_desk_lead", "Overdue invoices": "finance"}
        assert r.owner == expected.get(r.rule_name, managers[r.customer_id])


def test_one_owners_work_list(spark, tmp_path):
    log = ActionLog(spark, str(tmp_path / "log"))
    log.run_rules(load_rules(), at=FIRST)
    mine = actions.open_actions(log.entries(), owner="finance").collect()
    assert mine and {r.rule_name for r in mine} == {"Overdue invoices"}


def test_a_customer_found_twice_gives_one_action(spark):
    rule = dict(id="twice", name="Twice", owner="finance", priority="low", action="a")
    row = "SELECT 'C-1' AS customer_id, 'A' AS company_name, 'M' AS account_manager, '{}' AS reason"
    rule["sql"] = f"{row.format('b')} UNION ALL {row.format('a')}"
    hits = actions.all_hits(spark, [rule])
    raised = actions.new_actions(hits, actions.empty_log(spark), FIRST, 1)
    assert [r.reason for r in raised.collect()] == ["a"]
    counts = actions.rule_audit(hits, raised, [rule, rule | {"id": "none"}]).collect()
    assert sorted(map(tuple, counts)) == [("none", 0, 0), ("twice", 2, 1)]


def test_every_rule_is_audited(spark, tmp_path):
    audit = AuditLog(spark, str(tmp_path / "audit"))
    log = ActionLog(spark, str(tmp_path / "log"))
    work = log.run_rules(load_rules(), audit, FIRST)
    detail = {r.event: r.detail for r in audit.entries().collect()}
    assert set(detail) == {r["id"] for r in load_rules()}
    assert sum(int(d["new_actions"]) for d in detail.values()) == work.count()
    log.run_rules(load_rules(), audit, SECOND)
    newest = audit.tail(len(detail)).collect()
    assert {r.detail["new_actions"] for r in newest} == {"0"}


def test_audit_tail_is_newest_first(spark, tmp_path):
    audit = AuditLog(spark, str(tmp_path / "audit"))
    for n in range(4):
        audit.record("test", f"event{n}", {"n": n, "text": "a\nb"})
    assert [r.event for r in audit.tail(3).collect()] == ["event3", "event2", "event1"]
    assert audit.tail(1).first().detail == {"n": "3", "text": "a\nb"}


def test_a_tail_opens_few_files(spark, tmp_path):
    """1,000 parts of eight entries each, some of which overlap in time."""
    audit, expected = AuditLog(spark, str(tmp_path)), []
    for n in range(1000):
        start = datetime(2024, 1, 1) + timedelta(minutes=5 * n)
        rows = [{"ts": (start + timedelta(seconds=9 * i)).isoformat(), "seq": 8 * n + i, "layer": "l", "event": f"{n}/{i}", "detail": {}} for i in range(8)]
        part = tmp_path / f"day={rows[-1]['ts'][:10]}" / audit_module._part_name(rows[-1]["ts"], rows[0]["ts"], 8 * n + 7, 8)
        part.mkdir(parents=True)
        (part / "part-0.json").write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
        expected += rows
    newest = sorted(expected, key=lambda r: (r["ts"], r["seq"]), reverse=True)[:50]
    assert [r.event for r in audit.tail(50).collect()] == [r["event"] for r in newest]
    assert len(audit.tail(50).inputFiles()) < 10
    day = audit.entries(date(2024, 1, 2), date(2024, 1, 2))
    assert day.count() == sum(r["ts"].startswith("2024-01-02") for r in expected)
    assert audit.entries().count() == 8000 and all("day=2024-01-02" in f for f in day.inputFiles())


def test_entries_from_before_there_were_days(spark, tmp_path):
    (tmp_path / "part-0.json").write_text('{"ts":"2020-01-01T00:00:00","seq":1,"layer":"l","event":"old","detail":{}}\n', encoding="utf-8")
    audit = AuditLog(spark, str(tmp_path))
    audit.record("l", "new", {})
    assert [r.event for r in audit.tail(2).collect()] == ["new", "old"]
    assert [r.event for r in audit.tail(1).collect()] == ["new"] and audit.entries().count() == 2


def test_an_empty_log(spark, tmp_path):
    audit = AuditLog(spark, str(tmp_path / "none"))
    assert audit.tail(5).collect() == [] and audit.entries().collect() == []
    audit.append(audit.entries())
    assert audit.days() == []
