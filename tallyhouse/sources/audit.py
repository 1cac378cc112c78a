"""Append-only audit log as JSON lines, by day."""

from __future__ import annotations

import json
import time
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts string, seq bigint, layer string, event string, detail map<string,string>"


def _part_name(newest: str, oldest: str, seq: int, rows: int) -> str:
    """A part of the log is a folder that says from when to when it reaches and how many entries it has."""
    plain = [ts.replace("-", "").replace(":", "") for ts in (newest, oldest)]
    return f"p{plain[0]}-{seq:020d}-{plain[1]}-{rows}-{uuid.uuid4().hex[:12]}"


def audit_rows(frame: DataFrame, layer: str, event, detail: dict, at: datetime, seq: int) -> DataFrame:
    """Turn result rows into audit rows; ``detail`` maps names to columns."""
    pairs = [part for name, column in detail.items() for part in (F.lit(name), column.cast("string"))]
    return frame.select(
        F.lit(at.isoformat(timespec="seconds")).alias("ts"),
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(layer).alias("layer"),
        event.alias("event"),
        F.create_map(*pairs).alias("detail"),
    )


def newest_first(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries; ``seq`` orders entries within one second."""
    order = [F.desc("ts"), F.desc("seq"), F.desc("layer"), F.desc("event"), F.to_json("detail").desc()]
    return log.orderBy(*order).limit(n)


class AuditLog:
    """A folder of JSON lines that only ever grows.

    Each append is a part of its own below the day it belongs to; the part's name says from when to when it reaches and how
    many entries it has. So a tail knows from names alone which few parts it needs, and a span of days is read without the
    others. Files that lie in the folder itself, from before there were days, are read too.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, below: str = "") -> list[str]:
        path = self._path(below)
        return [status.getPath().getName() for status in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def append(self, rows: DataFrame) -> None:
        """Append entries, under the day of the latest one."""
        seen, draft = Observation(), f".draft-{uuid.uuid4().hex}"
        counted = rows.observe(
            seen, F.count("*").alias("rows"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.max("seq").alias("seq")
        )
        counted.write.json(f"{self.folder}/{draft}")
        found = seen.get
        if not found["rows"]:
            self._fs.delete(self._path(draft), True)
            return
        day = f"day={found['newest'][:10]}"
        self._fs.mkdirs(self._path(day))
        self._fs.rename(self._path(draft), self._path(f"{day}/{_part_name(**found)}"))

    def record(self, layer: str, event: str, detail: dict) -> None:
        """Append one entry."""
        self.record_many(layer, [(event, detail)])

    def record_many(self, layer: str, events: list[tuple[str, dict]]) -> None:
        """Append entries, in their order, in one write."""
        now, seq = datetime.now().isoformat(timespec="seconds"), time.time_ns()

        def row(at: int, event: str, detail: dict) -> tuple:
            text = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in detail.items()}
            return now, seq + at, layer, event, text

        rows = [row(at, *event) for at, event in enumerate(events)]
        self.append(self.spark.createDataFrame(rows, SCHEMA).coalesce(1))

    def record_rows(self, frame: DataFrame, layer: str, event, detail: dict) -> None:
        """Append one entry per row of a result, in one write."""
        self.append(audit_rows(frame, layer, event, detail, datetime.now(), time.time_ns()))

    def days(self) -> list[str]:
        return sorted(name.removeprefix("day=") for name in self._names() if name.startswith("day="))

    def _older(self) -> list[str]:
        """Files from before there were days."""
        return [name for name in self._names() if name.endswith(".json")]

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json([f"{self.folder}/{part}" for part in parts])

    def entries(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """All entries, or those of some days."""
        low, high = (first or date.min).isoformat(), (last or date.max).isoformat()
        days = [f"day={day}/p*" for day in self.days() if low <= day <= high]
        return self._read(days + (self._older() if first is None and last is None else []))

    def newest_parts(self, n: int) -> list[str]:
        """The parts that hold the last ``n`` entries: from the newest on until there are enough, and those that reach
        into the time of these."""
        taken, rows, since = [], 0, None
        for day in reversed(self.days()):
            for name in sorted((p for p in self._names(f"day={day}") if p.startswith("p")), reverse=True):
                newest, _, oldest, count, _ = name[1:].split("-")
                if rows >= n and newest < since:
                    return taken
                taken.append(f"day={day}/{name}")
                rows, since = rows + int(count), min(oldest, since or oldest)
        return taken + (self._older() if rows < n else [])

    def tail(self, n: int = 50) -> DataFrame:
        return newest_first(self._read(self.newest_parts(n)), n)
