"""Written tables in a folder that every executor can reach.

A written table cuts lineage: what follows reads Parquet, and a lost executor costs a
re-read instead of a re-run of the pipeline.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("Set spark.checkpoint.dir to a folder shared by driver and executors")
    folder = tempfile.mkdtemp(prefix="tallyhouse-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Store:
    """Named Parquet tables below one folder, each written once and then read back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._written: set[str] = set()

    @classmethod
    def fresh(cls, spark: SparkSession, label: str) -> "Store":
        """A new, empty store in the shared folder."""
        return cls(spark, f"{shared_folder(spark)}/tallyhouse/{label}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, spark: SparkSession | None = None) -> DataFrame:
        return (spark or self.spark).read.parquet(self.path(name))

    def write(self, name: str, frame: DataFrame) -> DataFrame:
        """Write a table, replacing one of an earlier run, and return it as read back."""
        frame.write.mode("overwrite").parquet(self.path(name))
        self._written.add(name)
        return self.read(name)

    def write_all(self, frames: dict[str, DataFrame], name: str = "{}") -> dict[str, DataFrame]:
        """Write independent tables side by side, so one's last tasks overlap the next's first."""
        with ThreadPoolExecutor(max(1, len(frames))) as pool:
            written = pool.map(self.write, (name.format(key) for key in frames), frames.values())
            return dict(zip(frames, written))

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table as this store wrote it; built and written on first use."""
        return self.read(name) if name in self._written else self.write(name, build())
