"""Numbered versions of a table or a group of tables, committed one after the other.

A version is a small JSON manifest that names the data it is made of. Data is written first, under names
of its own; committing creates the manifest with the next number if nobody else has. So readers see a
whole version or the one before, writers that started from the same version cannot both win, and files of a
task or run that was lost are never named.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

#: How often a change is tried again on top of what others have committed meanwhile.
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has committed the version that was to be written."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    content: dict = field(default_factory=dict)


class Versions:
    """The versions below one folder, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_versions")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = self._fs.makeQualified(path)

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(self._path))
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0].isdigit())

    def read(self, number: int) -> Version:
        stream = self._fs.open(self._file(f"{number:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, json.loads(text))

    def latest(self) -> Version:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else Version()

    def commit(self, after: Version, content: dict) -> Version:
        """The version that follows ``after``; a conflict if there is one already."""
        self._fs.mkdirs(self._path)
        draft, final = self._file(f".draft-{uuid.uuid4().hex}"), self._file(f"{after.number + 1:020d}.json")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        try:
            if not self._place(draft, final):
                raise Conflict(f"Version {after.number + 1} below {self._path.toString()} has been committed already")
        finally:
            self._fs.delete(draft, False)
        return Version(after.number + 1, content)

    def _place(self, draft, final) -> bool:
        """Give a file its final name if that is free, in one step.

        A rename does that on HDFS and does not replace files. On a local disk it would replace them, a link does not.
        """
        if self._path.toUri().getScheme() == "file":
            try:
                os.link(Path(draft.toUri().getPath()), Path(final.toUri().getPath()))
            except FileExistsError:
                return False
            return True
        return not self._fs.exists(final) and self._fs.rename(draft, final)

    def change(self, make: Callable[[Version], dict | None]) -> Version:
        """Commit what ``make`` makes of the latest version; made anew if another writer was first.

        ``make`` returns None where there is nothing to change.
        """
        for _ in range(ATTEMPTS):
            now = self.latest()
            content = make(now)
            if content is None:
                return now
            try:
                return self.commit(now, content)
            except Conflict:
                continue
        raise Conflict(f"Gave up after {ATTEMPTS} conflicts below {self._path.toString()}")
