"""The Bloom filter, and facts of many unknown customers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import ingest as ingesting
from tallyhouse.operators.key_filter import KeyFilter
from tallyhouse.sources.store import Store


@pytest.mark.parametrize("count", [1, 1000, 20_000])
def test_keys_are_never_missed_and_few_others_pass(spark, count):
    keys = spark.range(count).select(F.concat(F.lit("C-"), F.col("id").cast("string")).alias("key"))
    found = KeyFilter.of(keys, "key", count, Store.fresh(spark, "filter"), "filter").may_have(F.col("key"))
    assert keys.filter(~found).isEmpty()
    others = spark.range(count, count + 20_000).select(F.concat(F.lit("C-"), F.col("id").cast("string")).alias("key"))
    assert others.filter(found).count() <= 0.02 * 20_000


def test_null_and_no_keys(spark):
    none = spark.createDataFrame([], "key string")
    found = KeyFilter.of(none, "key", 0, Store.fresh(spark, "filter"), "filter").may_have(F.col("key"))
    rows = spark.createDataFrame([("a",), (None,)], "key string").select(found.alias("found")).collect()
    assert [r.found for r in rows] == [False, False]


def test_a_filter_that_is_too_small_only_lets_more_pass(spark, monkeypatch):
    monkeypatch.setattr("tallyhouse.operators.key_filter.MOST_BYTES", 64)
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    found = KeyFilter.of(keys, "key", 500, Store.fresh(spark, "filter"), "filter").may_have(F.col("key"))
    assert keys.filter(~found).isEmpty()


def test_a_look_up_names_the_words_once_and_the_key_twice(spark):
    """Else tasks carry a copy of the words for each bit, and a key pushed down to its scan is worked out for each."""
    keys = spark.range(1000).select(F.concat(F.lit("C-"), F.col("id").cast("string")).alias("key"))
    found = KeyFilter.of(keys, "key", 1000, Store.fresh(spark, "filter"), "filter").may_have(F.col("key"))
    plan = keys.filter(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Filter")[1].count("scalar-subquery") == 1
    assert plan.split("Filter")[1].count("concat(C-") == 2


def test_a_key_that_repeats_is_looked_up_alike(spark):
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "key string")
    found = KeyFilter.of(keys, "key", 4, Store.fresh(spark, "filter"), "filter").may_have(F.col("key"))
    assert [r.found for r in keys.select(found.alias("found")).collect()] == [True, True, False, True]


def facts_of(spark):
    """A third of the facts are one unknown customer's, others' keys are unknown, unreadable or fine."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'C-hot' WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN concat('U-', id) ELSE concat('C-', id % 100) END")
    return spark.range(6000).select(key.alias("customer_id"), F.col("id").cast("string").alias("_row"), F.lit("x").alias("product"))


def unknown_of(spark):
    keys = facts_of(spark).select("customer_id").distinct()
    return keys.filter("customer_id LIKE 'U-%' OR customer_id = 'C-hot'")


def marked(frame):
    return sorted((r["_row"], r.customer_id, r["_orphan"]) for r in frame.collect())


def test_many_orphans_are_marked_as_few_are(spark):
    store = Store.fresh(spark, "filter")
    facts, unknown = store.write("facts", facts_of(spark)), store.write("unknown", unknown_of(spark))
    few = marked(ingesting.mark_few_orphans(facts, unknown))
    assert marked(ingesting.mark_many_orphans(facts, unknown, unknown.count(), store, "x")) == few
    assert marked(ingesting.mark_orphans(facts, unknown)) == few
    assert len(few) == 6000 and sum(orphan for *_, orphan in few) == unknown.join(facts, "customer_id").count()


def test_only_doubtful_facts_move(spark):
    """Facts that the filter clears have no exchange above their scan; the hot unknown key lies in many partitions."""
    store = Store.fresh(spark, "filter")
    facts, unknown = store.write("facts", facts_of(spark)), store.write("unknown", unknown_of(spark))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        frame = ingesting.mark_many_orphans(facts, unknown, unknown.count(), store, "moved")
        union = frame._jdf.queryExecution().executedPlan()
        while union.nodeName() != "Union":
            union = union.children().head()
        fine, settled = (union.children().apply(i).toString() for i in (0, 1))
        assert "Exchange hashpartitioning" not in fine.split("Subquery")[0]
        assert "Exchange hashpartitioning" in settled
        hot = frame.filter("customer_id = 'C-hot'").select(F.spark_partition_id()).distinct().count()
        assert hot >= 4
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_ingest_above_the_broadcast_limit(spark, small, monkeypatch):
    from checks.extracts import extracts
    from tallyhouse.sources.config import load_sources

    def loaded():
        result = ingesting.ingest(extracts(spark, small, dirty=True), load_sources(), Store.fresh(spark, "filter"))
        return sorted(result.frame("invoice").collect(), key=str), sorted(result.quality_report().collect(), key=str)

    plain = loaded()
    monkeypatch.setattr(ingesting, "BROADCAST_KEYS", 0)
    assert loaded() == plain and plain[0] and plain[1]
