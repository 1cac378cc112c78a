"""Read source extracts as text columns, and Markdown folders as whole documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The text of a CSV line with more or fewer fields than its header; NULL for all other lines.
MALFORMED = "_malformed_line"


def _records_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether any CSV record may run over a line end.

    Such a record leaves a line with an odd number of quotes. The check is one pass
    over splittable text and saves reading every file in a single task.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _read_csv(spark: SparkSession, path: str, layout: str | None) -> DataFrame:
    whole_files = layout != "lines" and _records_span_lines(spark, path)
    form = dict(header=True, quote='"', escape='"', multiLine=whole_files, enforceSchema=False)
    names = spark.read.csv(path, **form).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, MALFORMED]])
    frame = spark.read.schema(schema).csv(path, columnNameOfCorruptRecord=MALFORMED, **form)
    return frame.na.fill("", names)  # an empty CSV field is empty text, not a missing value


#: Records whose fields are looked at before all are.
FIRST_RECORDS = 1000


def _json_fields(spark: SparkSession, path: str, layout: str | None, wanted: set[str]) -> set[str]:
    """Those of the wanted fields that some record has, be it as null.

    The first lines nearly always tell; only if they do not are the names in all lines looked at, not the values. A file
    that is one array is parsed as a whole, as it will be for reading.
    """
    if layout != "lines":
        return wanted & set(spark.read.json(path, multiLine=True).columns)
    names = spark.read.text(path).select(F.json_object_keys("value").alias("names"))
    for rows in (names.limit(FIRST_RECORDS), names):
        listed = rows.select(F.explode("names").alias("name")).filter(F.col("name").isin(*wanted))
        found = {row.name for row in listed.distinct().collect()}  # no more than are wanted
        if found == wanted:
            break
    return found


def _read_json(spark: SparkSession, path: str, layout: str | None, fields: list[str]) -> DataFrame:
    lacking = set(fields) - _json_fields(spark, path, layout, set(fields))
    if lacking:
        raise ValueError(f"No record of {path} has {sorted(lacking)}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return spark.read.schema(schema).json(path, multiLine=layout != "lines", mode="FAILFAST")


def read_source(spark: SparkSession, folder: str, source: dict) -> DataFrame:
    """One source's extract, every column as text."""
    path = f"{folder.rstrip('/')}/{source['file']}"
    fmt, layout = source["format"], source.get("layout")
    if fmt == "csv":
        return _read_csv(spark, path, layout)
    if fmt == "json":
        key = source.get("key", {}).get("field")
        wanted = [*source["fields"], *source.get("locator", []), *([key] if key else [])]
        return _read_json(spark, path, layout, list(dict.fromkeys(wanted)))
    raise ValueError(f"Unsupported format {fmt}")


def read_sources(spark: SparkSession, folder: str, mapping: dict[str, dict]) -> dict[str, DataFrame]:
    return {name: read_source(spark, folder, source) for name, source in mapping.items()}


#: Bytes of small files that one task reads; the text reader alone gives a task a few dozen files, whatever their size.
TASK_BYTES = 16 << 20
#: The driver lists folders of so many Markdown files at most: it keeps each file's name and status, a few KB, until they are read.
LISTED_FILES = 10_000


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.md`` file of a folder: ``doc`` (file name without suffix) and ``text``.

    Folders inside it are neither read nor taken for partitions. A folder of more than ``LISTED_FILES`` is listed by a
    task and read by tasks that get names, so the driver holds none of them; pyarrow must be able to open its store, else
    the driver lists it whole.
    """
    folder = folder.rstrip("/")
    count, size = _folder_size(spark, folder)
    return _read_by_name(spark, folder, size) if count > LISTED_FILES else _read_listed(spark, folder)


def _read_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files by Spark's reader. The folder is listed once; a pattern in the path would have each file it matches
    listed again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    depth = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth()
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    inside = F.regexp_replace("_metadata.file_path", r"^[^:/]+:(//[^/]*)?", "")
    files = found.filter(F.size(F.split(inside, "/")) == depth + 2)
    parts = files.rdd.getNumPartitions()
    if not parts:
        files = spark.read.text(f"{folder}/*.md", wholetext=True)  # an error where there are none
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    texts = files.select(F.url_decode(name).alias("doc"), F.col("value").alias("text"))
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return texts.coalesce(tasks) if tasks < parts else texts


def _uri(spark: SparkSession, folder: str) -> str | None:
    """The folder as pyarrow opens it; None for a pattern, for what is no folder and for stores that it does not know."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(c in folder for c in "*?[]{}\\") or not (store.exists(path) and store.getFileStatus(path).isDirectory()):
        return None
    uri = store.makeQualified(path).toUri().toASCIIString()
    try:
        from pyarrow import fs

        fs.FileSystem.from_uri(uri)
    except (ImportError, ValueError, OSError):
        return None
    return uri


def _listing(uri: str):
    """A function that yields name and size of a folder's Markdown files, those that Spark's reader takes, one by one."""

    def listed(sized: bool):
        import os

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)

        def wanted(name: str) -> bool:
            return name.endswith(".md") and name[0] != "." and (name[0] != "_" or "=" in name)

        if isinstance(store, fs.LocalFileSystem):  # pyarrow would make a list of all
            with os.scandir(top) as entries:
                for entry in entries:
                    if wanted(entry.name) and entry.is_file():
                        yield entry.name, entry.stat().st_size if sized else 0
        else:
            for found in store.get_file_info(fs.FileSelector(top)):
                if wanted(found.base_name) and found.is_file:
                    yield found.base_name, found.size

    return listed


def _folder_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number and bytes of a folder's Markdown files, counted by a task; none where only Spark's reader can tell."""
    uri = _uri(spark, folder)
    if uri is None:
        return 0, 0
    listed = _listing(uri)

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            count = size = 0
            for _, one in listed(True):
                count, size = count + 1, size + one
            yield pa.RecordBatch.from_pydict({"count": pa.array([count], pa.int64()), "size": pa.array([size], pa.int64())})

    found = spark.range(0, 1, 1, 1).mapInArrow(run, "count long, size long").first()
    return found["count"], found["size"]


#: File names, and bytes of text, that go from Python to Spark together.
_NAMES, _TEXT_BYTES = 10_000, 4 << 20


def _read_by_name(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """Markdown files by their names, which one task lists and a shuffle spreads over the tasks that read them."""
    uri, names_at_once, bytes_at_once = _uri(spark, folder), _NAMES, _TEXT_BYTES
    listed = _listing(uri)

    def name_files(batches):
        from itertools import islice

        import pyarrow as pa

        for _ in batches:
            names = (name for name, _ in listed(False))
            while some := list(islice(names, names_at_once)):
                yield pa.RecordBatch.from_pydict({"name": pa.array(some, pa.string())})

    def read_files(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)

        def rows(names, texts):
            return pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(texts, pa.binary())})

        for batch in batches:
            names, texts, held = [], [], 0
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{top}/{name}") as file:
                    text = file.read()
                if not text:
                    continue  # as Spark's reader does
                names.append(name)
                texts.append(text)
                held += len(text)
                if held >= bytes_at_once:
                    yield rows(names, texts)
                    names, texts, held = [], [], 0
            yield rows(names, texts)

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    names = spark.range(0, 1, 1, 1).mapInArrow(name_files, "name string").repartition(tasks, "name")
    texts = names.mapInArrow(read_files, "name string, content binary")
    # A plus sign in a name is a space in doc, as it is where the names come from Spark's reader.
    doc = F.translate(F.regexp_replace("name", r"\.md$", ""), "+", " ")
    return texts.select(doc.alias("doc"), F.col("content").cast("string").alias("text"))
