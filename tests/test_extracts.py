"""How the test tables are read."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.extracts import spread_table

ROWS = 40_000


@pytest.fixture
def parts_of_a_file(spark):
    """Files are cut into more parts than there are cores."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def spread(spark, folder, group):
    numbers = random.Random(1)
    rows = {"k": list(range(ROWS)), "v": [numbers.random() for _ in range(ROWS)]}
    pq.write_table(pa.table(rows), f"{folder}/orders.parquet", row_group_size=group)
    return spread_table(spark, str(folder), "orders", "k", "v")


def held(frame):
    return [row.n for row in frame.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_rows_of_one_row_group_are_spread_over_the_cores(spark, tmp_path, parts_of_a_file):
    found = held(spread(spark, tmp_path, ROWS))
    assert sum(found) == ROWS and max(found) * spark.sparkContext.defaultParallelism <= 3 * ROWS


def test_rows_of_many_row_groups_stay_where_they_are(spark, tmp_path, parts_of_a_file):
    frame = spread(spark, tmp_path, 500)
    assert "Repartition" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert sum(held(frame)) == ROWS
