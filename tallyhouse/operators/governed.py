"""Governed queries: one read-only SELECT over the approved tables, capped.

Spark parses and analyses; nothing is executed before the check. The query must parse by itself and
as a subquery (commands, DML and statement chains do not). Its analysed plan may then hold nothing
but relational operators, built-in expressions and the files of the approved tables. What the
query's text looks like, in literals or in spellings of a name, decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.plans.marts import TABLES
from tallyhouse.sources.audit import AuditLog

MAX_ROWS = 500
MAX_RECORDS = 50
RECORD_DECIMALS = 2
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"
# Operators a query may use; script transformations, commands and other relations are not among them.
_OPERATORS = frozenset(
    """
    Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit Intersect Join
    LateralJoin LocalLimit LocalRelation LogicalRelation Offset OneRowRelation Project Sort SubqueryAlias
    Union View Window WithCTE
    """.split()
)
_BUILT_IN = "org.apache.spark.sql.catalyst.expressions."
# Built-in expressions that run code from outside the plan, or read files by themselves.
_OUTSIDE = ("CallMethodViaReflection", "Protobuf", "UDF", "UDAF", "UDTF", "UserDefined")
_COPIED = (
    "spark.sql.session.timeZone",
    "spark.sql.shuffle.partitions",
    "spark.sql.ansi.enabled",
)


class UnsafeQuery(ValueError):
    """The query is not a single read-only SELECT over approved tables."""


class FailedQuery(RuntimeError):
    """The query was allowed but stopped while it ran."""


def _each(items: JavaObject) -> Iterator[JavaObject]:
    for at in range(items.size()):
        yield items.apply(at)


def _tree(node: JavaObject) -> Iterator[JavaObject]:
    yield node
    for child in _each(node.children()):
        yield from _tree(child)


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """Every operator of a plan, those of subqueries included."""
    yield from _tree(plan)
    for subquery in _each(plan.subqueriesAll()):
        yield from _tree(subquery)


def _analysed(frame: DataFrame) -> JavaObject:
    return frame._jdf.queryExecution().analyzed()


def _files(relation: JavaObject) -> str:
    """The folders that a scan reads, and the saved table they are read as."""
    source = relation.relation()
    folders = source.location().rootPaths().toString() if source.getClass().getSimpleName() == "HadoopFsRelation" else ""
    return f"{relation.catalogTable().toString()} {folders}"


def as_records(frame: DataFrame, limit: int = MAX_RECORDS) -> DataFrame:
    """The first rows as JSON records: ISO dates, doubles with two decimals, NULLs kept."""

    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.round(column, RECORD_DECIMALS).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, ISO).alias(field.name)
        return column

    columns = [shown(field) for field in frame.schema.fields]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return frame.limit(limit).select(record.alias("record"))


class GovernedSession:
    """A session that can see the approved tables and nothing else."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], audit: AuditLog | None = None):
        """``paths`` maps table names to their Parquet folders."""
        strangers = sorted(set(paths) - set(TABLES))
        if strangers:
            raise ValueError(f"Not approved for governed queries: {strangers}")
        self.audit = audit
        self.spark = spark.newSession()
        for key in _COPIED:
            self.spark.conf.set(key, spark.conf.get(key))
        self._approved = set()
        for name, path in paths.items():
            table = self.spark.read.parquet(path)
            table.createOrReplaceTempView(name)
            self._approved.add(_files(_analysed(table)))
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")

    def _capped(self, sql: str, max_rows: int) -> tuple[str, DataFrame]:
        query = sql.strip().removesuffix(";")
        capped = f"SELECT * FROM (\n{query}\n) AS q LIMIT {max_rows}"
        try:
            self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
            frame = self.spark.sql(capped)
        except (PySparkException, Py4JJavaError) as error:
            raise UnsafeQuery(f"Not a single SELECT over approved tables: {error}") from error
        for node in _nodes(_analysed(frame)):
            self._check(node)
        return capped, frame

    def _check(self, node: JavaObject) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in _OPERATORS:
            raise UnsafeQuery(f"{kind} is not allowed.")
        if kind == "LogicalRelation" and _files(node) not in self._approved:
            raise UnsafeQuery("Only the approved tables may be read.")
        for expression in _each(node.expressions()):
            for part in _tree(expression):
                name = part.getClass().getName()
                if not name.startswith(_BUILT_IN) or any(word in name for word in _OUTSIDE):
                    raise UnsafeQuery(f"{name.rpartition('.')[2]} is not allowed.")

    def guard(self, sql: str, max_rows: int = MAX_ROWS) -> str:
        """The capped query that is safe to run, or ``UnsafeQuery``. Nothing is executed."""
        return self._capped(sql, max_rows)[0]

    def query(self, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
        return self._capped(sql, max_rows)[1]

    def run(self, sql: str, purpose: str = "") -> list[str]:
        """At most 50 JSON records of a query; the run, refusal or failure goes to the audit log."""
        try:
            frame = self.query(sql)
        except UnsafeQuery as error:
            self._record("sql_blocked", {"sql": sql, "reason": str(error)})
            raise
        try:
            records = [row.record for row in as_records(frame, MAX_ROWS).collect()]
        except PySparkException as error:
            self._record("sql_failed", {"purpose": purpose, "sql": sql, "reason": str(error)})
            raise FailedQuery(str(error)) from error
        self._record("sql_run", {"purpose": purpose, "sql": sql, "rows": len(records)})
        return records[:MAX_RECORDS]

    def _record(self, event: str, detail: dict) -> None:
        if self.audit:
            self.audit.record("query", event, detail)
