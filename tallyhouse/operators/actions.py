"""Rules that raise workflow actions, and the append-only log that keeps them idempotent.

The log gets one entry per change of an action. An action's state is its entry with the
highest run number; nothing is updated in place.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.audit import AuditLog
from tallyhouse.sources.store import Store
from tallyhouse.sources.versions import Version, Versions

SCHEMA = (
    "action_key string, rule_id string, rule_name string, priority string, owner string, "
    "customer_id string, company_name string, account_manager string, reason string, "
    "action string, status string, raised_at timestamp_ntz, run bigint"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
MANAGER = "account_manager"  # an owner that stands for the manager of the account
OPEN = "open"
# A log of more parts than this is compacted after a run.
MOST_PARTS = 32
HIT = ("customer_id", "company_name", "account_manager", "reason")


def empty_log(spark: SparkSession) -> DataFrame:
    nulls = (f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, SCHEMA.split(", ")))
    return spark.sql(f"SELECT {', '.join(nulls)} WHERE false")


def rule_hits(spark: SparkSession, rule: dict) -> DataFrame:
    """What a rule finds in the registered marts: by its own ``sql``, or the rows of a ``table``
    for which ``when`` holds, with ``reason`` as an expression."""
    if "sql" in rule:
        return spark.sql(rule["sql"]).select(*HIT)
    found = spark.table(rule["table"]).filter(rule["when"])
    return found.withColumn("reason", F.expr(rule["reason"])).select(*HIT)


def all_hits(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The hits of every rule as unnumbered open actions."""

    def actions(rule: dict) -> DataFrame:
        owner = F.col("account_manager") if rule["owner"] == MANAGER else F.lit(rule["owner"])
        return rule_hits(spark, rule).select(
            F.concat(F.lit(f"{rule['id']}:"), F.col("customer_id")).alias("action_key"),
            F.lit(rule["id"]).alias("rule_id"),
            F.lit(rule["name"]).alias("rule_name"),
            F.lit(rule["priority"]).alias("priority"),
            owner.alias("owner"),
            "customer_id",
            "company_name",
            "account_manager",
            "reason",
            F.lit(rule["action"]).alias("action"),
        )

    none = empty_log(spark).drop("status", "raised_at", "run")
    return reduce(DataFrame.unionByName, (actions(rule) for rule in rules), none)


def state(log: DataFrame) -> DataFrame:
    """The latest entry of every action."""
    rest = F.struct(*COLUMNS[1:])
    newest = log.groupBy("action_key").agg(F.max_by(rest, "run").alias("entry"))
    return newest.select("action_key", "entry.*")


def open_entries(log: DataFrame) -> DataFrame:
    return state(log).filter(F.col("status") == OPEN)


def new_actions(hits: DataFrame, log: DataFrame, at: datetime, run: int) -> DataFrame:
    """Entries to append: one per hit that has no open action. A closed action opens again."""
    details = [c for c in hits.columns if c != "action_key"]
    one_per_key = hits.groupBy("action_key").agg(F.min(F.struct(*details)).alias("hit"))
    fresh = one_per_key.join(open_entries(log).select("action_key"), "action_key", "left_anti")
    return fresh.select(
        "action_key",
        "hit.*",
        F.lit(OPEN).alias("status"),
        F.lit(at.isoformat(" ", "seconds")).cast("timestamp_ntz").alias("raised_at"),
        F.lit(run).cast("bigint").alias("run"),
    ).select(*COLUMNS)


def closing(log: DataFrame, which: Column, run: int) -> DataFrame:
    """Entries that close the open actions for which a condition holds."""
    return (
        open_entries(log)
        .filter(which)
        .withColumn("status", F.lit("closed"))
        .withColumn("run", F.lit(run).cast("bigint"))
        .select(*COLUMNS)
    )


def priority_rank() -> Column:
    priority = F.col("priority")
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def open_actions(log: DataFrame, owner: str | None = None) -> DataFrame:
    """The work list, most urgent first; of everybody or of one owner."""
    entries = open_entries(log)
    if owner is not None:
        entries = entries.filter(F.col("owner") == owner)
    return (
        entries.orderBy(priority_rank(), "rule_name", "company_name", "customer_id")
        .select(
            "rule_name",
            "priority",
            "owner",
            "customer_id",
            "company_name",
            "reason",
            "action",
            "status",
            "raised_at",
        )
    )


def actions_by_rule(log: DataFrame) -> DataFrame:
    return open_entries(log).groupBy("rule_name").agg(F.count("*").alias("actions"))


def actions_by_owner(log: DataFrame) -> DataFrame:
    return open_entries(log).groupBy("owner").agg(F.count("*").alias("actions")).orderBy("owner")


def action_metrics(log: DataFrame) -> DataFrame:
    return open_entries(log).agg(
        F.count("*").alias("open_actions"),
        F.count_if(F.col("priority") == "high").alias("high_priority"),
        F.countDistinct("owner").alias("owners"),
    )


def rule_audit(hits: DataFrame, raised: DataFrame, rules: list[dict]) -> DataFrame:
    """Matches and new actions of every rule, also of those that found nothing."""
    if not rules:
        return hits.sparkSession.createDataFrame([], "rule_id string, matches bigint, new_actions bigint")
    ids = [F.lit(rule["id"]) for rule in rules]
    nothing = hits.sparkSession.range(1).select(F.explode(F.array(*ids)).alias("rule_id"))
    counted = reduce(
        DataFrame.unionByName,
        (
            nothing.select("rule_id", F.lit(0).alias("match"), F.lit(0).alias("new")),
            hits.select("rule_id", F.lit(1).alias("match"), F.lit(0).alias("new")),
            raised.select("rule_id", F.lit(0).alias("match"), F.lit(1).alias("new")),
        ),
    )
    return counted.groupBy("rule_id").agg(
        F.sum("match").alias("matches"), F.sum("new").alias("new_actions")
    )


class ActionLog:
    """The action log of a folder; it outlives mart rebuilds.

    Entries lie in parts, Parquet folders that are never changed. A version of the log names its parts, so readers hold on
    to what they opened. A run that finds another one committed before it decides again on top of that, so an action is
    raised once however many runs there are at a time. Runs are numbered by the clock in nanoseconds, and above all
    earlier ones. ``compact`` keeps the latest entry of each action, so a run reads no more than that and what is new.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.versions = Versions(spark, self.folder)

    def snapshot(self) -> Version:
        """The log as it is now."""
        return self.versions.latest()

    def entries(self, version: Version | None = None) -> DataFrame:
        """The entries of a version; of the latest one if none is given."""
        parts = (version or self.snapshot()).content.get("parts", [])
        if not parts:
            return empty_log(self.spark)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{part}" for part in parts))

    def _next_run(self, version: Version | None = None) -> int:
        return max(time.time_ns(), (version or self.snapshot()).content.get("run", 0) + 1)

    def _part(self, entries: DataFrame) -> tuple[str, int]:
        """Entries as a part that no version names yet, and their number."""
        name = f"part-{uuid.uuid4().hex}"
        seen = Observation()
        counted = entries.observe(seen, F.count("*").alias("rows"))
        counted.write.parquet(f"{self.folder}/{name}")
        return name, seen.get["rows"]

    def _change(self, make: Callable[[Version, int], DataFrame]) -> Version:
        """Commit the entries that ``make`` makes of a version and a run number; nothing if there are none."""

        def content(now: Version) -> dict | None:
            run = self._next_run(now)
            name, rows = self._part(make(now, run))
            return {"parts": [*now.content.get("parts", []), name], "run": run} if rows else None

        version = self.versions.change(content)
        return self.compact() if len(version.content.get("parts", [])) > MOST_PARTS else version

    def _append(self, entries: DataFrame) -> Version:
        return self._change(lambda now, run: entries)

    def run_rules(
        self, rules: list[dict], audit: AuditLog | None = None, at: datetime | None = None
    ) -> DataFrame:
        """Evaluate rules over the registered marts, raise what is new, return the work list.

        The hits are written first, so each rule's SQL runs once for the log and the audit.
        """
        hits = Store.fresh(self.spark, "actions").write("hits", all_hits(self.spark, rules))
        moment, raised = at or datetime.now(), []

        def fresh(now: Version, run: int) -> DataFrame:
            raised[:] = [now, run]
            return new_actions(hits, self.entries(now), moment, run)

        after = self._change(fresh)
        if audit:
            before, run = raised
            counts = rule_audit(hits, self.entries(after).filter(F.col("run") == run), rules)
            audit.record_rows(
                counts,
                "automation",
                F.col("rule_id"),
                {"matches": F.col("matches"), "new_actions": F.col("new_actions")},
            )
        return open_actions(self.entries(after))

    def close(self, which: Column) -> None:
        """Close the open actions for which a condition holds."""
        self._change(lambda now, run: closing(self.entries(now), which, run))

    def compact(self) -> Version:
        """A version of one part, with the latest entry of each action. Earlier versions stay as they are."""

        def content(now: Version) -> dict | None:
            if len(now.content.get("parts", [])) < 2:
                return None
            name, _ = self._part(state(self.entries(now)))
            return {"parts": [name], "run": now.content["run"]}

        return self.versions.change(content)
