"""What the Arrow-based operators share: shipping this package, bounded batches, free column names."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Text that is worked on at once in a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tallyhouse-llm-")) / "tallyhouse_llm.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(PACKAGE.rglob("*.py")):
            out.write(module, module.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._llm_shipped = True


def bounded(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose values of ``column`` take about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.column(column).nbytes // batch.num_rows)
        if per_row * batch.num_rows <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark reads it by, so that tasks open the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """A qualified folder's file system and its path there."""
    return fs.FileSystem.from_uri(folder)


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, or the first longer name that no column of the frame has, in any case of letters."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
