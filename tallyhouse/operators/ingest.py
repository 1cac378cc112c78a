"""Bring raw extracts onto one vocabulary, with quality issues and lineage.

Parsing is one narrow projection per source. Wide fact rows never move: the check that every
fact belongs to a known customer shuffles distinct keys only, and the few unknown keys go
back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyhouse.functions import parsing
from tallyhouse.functions.keys import canonical_key
from tallyhouse.operators.key_filter import KeyFilter
from tallyhouse.sources.files import MALFORMED
from tallyhouse.sources.store import Store

KEY = "customer_id"
CUSTOMER = "customer"
UNKNOWN_KEY = "unrecognised customer key"
BAD_LINE = "wrong number of fields"
ORPHAN = "no matching CRM account (quarantined)"
# Above this many unknown keys a Bloom filter of them is sent to the facts instead of the keys: two bytes a key. The driver
# builds what is broadcast, the keys of several sources at once, at some 140 bytes a key and more while it does.
BROADCAST_KEYS = 50_000
# Facts that a filter lets pass are joined in so many parts for each key.
SALTS = 16

_ROW, _ISSUES, _ORPHAN, _MALFORMED, _SALT = "_row", "_issues", "_orphan", "_malformed", "_salt"


def _issue(source: str, field: str, problem: str) -> Column:
    return F.struct(
        F.lit(source).alias("source"),
        F.col(_ROW).alias("row"),
        F.lit(field).alias("field"),
        F.lit(problem).alias("problem"),
    )


def parse_source(raw: DataFrame, name: str, source: dict) -> DataFrame:
    """Key, rename, type and transform one source; every row is kept, with its issues beside it."""
    key_field, fields = source["key"]["field"], source["fields"]
    locator = source.get("locator", [key_field])
    missing = {key_field, *locator, *fields} - set(raw.columns)
    if missing:
        raise ValueError(f"Source {name} lacks {sorted(missing)}")

    types, transforms = source.get("types", {}), source.get("transforms", {})
    texts = {new: F.col(f"`{old}`") for old, new in fields.items() if new != KEY}
    typed = [
        parsing.parse(text, types[new]).alias(new) if new in types else text.alias(new)
        for new, text in texts.items()
    ]
    originals = [text.alias(f"_raw_{new}") for new, text in texts.items() if new in types]
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in raw.columns else F.lit(False)
    frame = raw.select(
        malformed.alias(_MALFORMED),
        F.concat_ws("|", *(F.col(f"`{f}`").cast("string") for f in locator)).alias(_ROW),
        canonical_key(F.col(f"`{key_field}`"), source["key"]["pattern"]).alias(KEY),
        *typed,
        *originals,
    )
    problems = [
        (F.col(_MALFORMED), _issue(name, "line", BAD_LINE)),
        (F.col(KEY).isNull(), _issue(name, key_field, UNKNOWN_KEY)),
    ]
    problems += [
        (
            parsing.unreadable(F.col(f"_raw_{new}"), F.col(new)),
            _issue(name, new, f"could not parse as {spec['type']}"),
        )
        for new, spec in types.items()
    ]
    any_problem = reduce(Column.__or__, (found for found, _ in problems))
    issues = F.array_compact(F.array(*(F.when(found, issue) for found, issue in problems)))
    columns = [
        parsing.transform(transforms[new], F.col(new)).alias(new) if new in transforms else F.col(new)
        for new in fields.values()
    ]
    return frame.select(_ROW, *columns, F.when(any_problem, issues).alias(_ISSUES))


def unknown_keys(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct keys of a fact source that no customer has, and how many facts have each (``n``)."""
    keys = facts.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("n"))
    return keys.join(known, KEY, "left_anti")


def possible_issues(source: dict) -> list[tuple[str, str]]:
    """Field and problem of each issue that a record by itself can have."""
    types = source.get("types", {})
    return [("line", BAD_LINE), (source["key"]["field"], UNKNOWN_KEY)] + [(new, f"could not parse as {t['type']}") for new, t in types.items()]


def _observed(rows: DataFrame, source: dict) -> tuple[DataFrame, Observation]:
    """Parsed rows that are counted as they pass: how many, how many with a key, how many with each issue."""
    seen = Observation()

    def of(field: str, problem: str) -> Column:
        return F.exists(_ISSUES, lambda issue: (issue["field"] == field) & (issue["problem"] == problem))

    issues = [F.count_if(of(*issue)).alias(f"issue_{at}") for at, issue in enumerate(possible_issues(source))]
    return rows.observe(seen, F.count("*").alias("rows_in"), F.count(KEY).alias("keyed"), *issues), seen


def _marked(facts: DataFrame, orphans: DataFrame) -> DataFrame:
    marks = orphans.select(KEY, F.lit(True).alias(_ORPHAN))
    return facts.join(marks, KEY, "left").withColumn(_ORPHAN, F.coalesce(_ORPHAN, F.lit(False)))


def mark_orphans(facts: DataFrame, orphans: DataFrame) -> DataFrame:
    """Mark facts of unknown customers, by a broadcast or a shuffle as Spark sees fit. Rows without a readable key
    pass by the join: by a shuffle all of them would go to one task."""
    keyed = _marked(facts.filter(F.col(KEY).isNotNull()), orphans)
    return keyed.unionByName(facts.filter(F.col(KEY).isNull()).withColumn(_ORPHAN, F.lit(False)))


def mark_few_orphans(facts: DataFrame, orphans: DataFrame) -> DataFrame:
    """Mark facts by a counted broadcast: one scan, no row moves."""
    return _marked(facts, F.broadcast(orphans))


def mark_many_orphans(facts: DataFrame, orphans: DataFrame, count: int, store: Store, label: str) -> DataFrame:
    """Mark facts of more unknown customers than are broadcast.

    A Bloom filter of the unknown keys tells which facts are fine; they stay where they are. Only what it lets
    pass, the orphans themselves and a few false positives, is joined with the keys; a hot unknown key is split over
    salts first.
    """
    unknown = KeyFilter.of(orphans, KEY, count, store, f"filter_{label}")
    doubtful = unknown.may_have(F.col(KEY))
    fine = facts.filter(~doubtful).withColumn(_ORPHAN, F.lit(False))
    return fine.unionByName(_settled(facts.filter(doubtful), orphans))


def _settled(facts: DataFrame, orphans: DataFrame) -> DataFrame:
    """Mark facts by a join that splits a key over salts. No key matches null, so these rows go anywhere."""
    row = F.xxhash64(_ROW)
    checked = facts.withColumn(_SALT, F.when(F.col(KEY).isNull(), row).otherwise(F.pmod(row, F.lit(SALTS))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    marks = orphans.select(KEY, F.lit(True).alias(_ORPHAN)).withColumn(_SALT, every)
    return checked.join(marks, [KEY, _SALT], "left").drop(_SALT).withColumn(_ORPHAN, F.coalesce(_ORPHAN, F.lit(False)))


def not_loaded(facts: DataFrame, row: Column, orphans: DataFrame, count: int, store: Store, label: str) -> DataFrame:
    """Delivered facts that are held back, in the way the ingest marks them: no readable key, or one of ``count`` unknown ones.

    The others are left out where they are read, once, so few of many records move.
    """
    if count <= BROADCAST_KEYS:
        marked = mark_few_orphans(facts, orphans)
    else:
        unknown = KeyFilter.of(orphans, KEY, count, store, f"filter_rejected_{label}")
        doubtful = F.col(KEY).isNull() | unknown.may_have(F.col(KEY))
        marked = _settled(facts.filter(doubtful).withColumn(_ROW, row), orphans)
    return marked.filter(F.col(KEY).isNull() | F.col(_ORPHAN))


@dataclass
class Source:
    """One parsed source: all its rows, marked where they are not loaded."""

    name: str
    config: dict
    rows: DataFrame
    #: rows_in, rows_loaded, orphans and the number of each possible issue, if they were counted while writing.
    counts: dict | None = None
    #: How many keys no customer has, if they were counted.
    unknown: int | None = None

    @property
    def entity(self) -> str:
        return self.config["entity"]

    @property
    def loaded(self) -> Column:
        return F.col(KEY).isNotNull() & ~F.col(_ORPHAN)

    @property
    def columns(self) -> list[str]:
        """Mapped columns; those with personal data only while nothing has been written."""
        return [c for c in self.config["fields"].values() if c in self.rows.columns]

    def frame(self) -> DataFrame:
        return self.rows.filter(self.loaded).select(*self.columns)

    def issues(self) -> DataFrame:
        orphan = F.when(F.col(_ORPHAN), _issue(self.entity, KEY, ORPHAN))
        found = F.array_compact(F.array_append(F.coalesce(_ISSUES, F.array()), orphan))
        flagged = self.rows.filter(F.col(_ISSUES).isNotNull() | F.col(_ORPHAN))
        return flagged.select(F.inline(found))

    def lineage(self) -> DataFrame:
        """Where the entity comes from and how many rows; needs no scan where they were counted while writing."""
        pii = [F.lit(name) for name in self.config.get("pii", [])]
        if self.counts:
            counted = self.rows.sparkSession.range(1).select(
                *(F.lit(self.counts[name]).cast("bigint").alias(name) for name in ("rows_in", "rows_loaded"))
            )
        else:
            counted = self.rows.agg(F.count("*").alias("rows_in"), F.count_if(self.loaded).alias("rows_loaded"))
        return counted.select(
            F.lit(self.entity).alias("entity"),
            F.lit(self.name).alias("source_system"),
            F.lit(self.config["file"]).alias("file"),
            "rows_in",
            "rows_loaded",
            F.array(*pii).cast("array<string>").alias("pii_fields"),
        )


def _counts(name: str, source: dict, seen: dict, orphans: int) -> dict:
    """Counts of a source, from what was seen of its rows and the number of its orphans."""
    issues = [(name, *issue, seen[f"issue_{at}"]) for at, issue in enumerate(possible_issues(source))]
    issues.append((source["entity"], KEY, ORPHAN, orphans))
    return {"rows_in": seen["rows_in"], "rows_loaded": seen["keyed"] - orphans, "orphans": orphans, "issues": issues}


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass
class IngestResult:
    sources: dict[str, Source]

    def source_of(self, entity: str) -> Source:
        return next(s for s in self.sources.values() if s.entity == entity)

    def frame(self, entity: str) -> DataFrame:
        """The loaded rows of one entity."""
        return self.source_of(entity).frame()

    def without_pii(self, entity: str) -> DataFrame:
        return self.frame(entity).drop(*self.source_of(entity).config.get("pii", []))

    def orphans(self, entity: str) -> DataFrame:
        """Rows held back because no customer has their key."""
        source = self.source_of(entity)
        return source.rows.filter(F.col(_ORPHAN)).select(*source.columns)

    def quality_report(self) -> DataFrame:
        """Every issue: source, row (the record's locator), field, problem."""
        return _union(s.issues() for s in self.sources.values())

    def issue_counts(self) -> DataFrame:
        """source, field, problem and number of issues; from the counts taken while writing, where there are any."""
        report = _union(s.issues() for s in self.sources.values() if not s.counts) if not all(s.counts for s in self.sources.values()) else None
        counted = [row for s in self.sources.values() if s.counts for row in s.counts["issues"]]
        spark = next(iter(self.sources.values())).rows.sparkSession
        frame = spark.createDataFrame(counted, "source string, field string, problem string, issues bigint").filter("issues > 0")
        if report is None:
            return frame
        return frame.unionByName(report.groupBy("source", "field", "problem").agg(F.count("*").alias("issues")))

    def lineage(self) -> DataFrame:
        return _union(s.lineage() for s in self.sources.values())


def ingest(raw: dict[str, DataFrame], mapping: dict[str, dict], store: Store | None = None) -> IngestResult:
    """Ingest every source of a mapping.

    With a store, each parsed source is written once, so text is parsed once however many
    results are read from it, and its rows and issues are counted as they are written. Unknown
    keys are counted before they are broadcast. Columns
    with personal data are dropped before that; without a store they are there, in memory only.
    """

    parsed = {name: parse_source(raw[name], name, source) for name, source in mapping.items()}
    seen: dict[str, Observation] = {}
    if store:
        kept = {}
        for name, rows in parsed.items():
            kept[name], seen[name] = _observed(rows.drop(*mapping[name].get("pii", [])), mapping[name])
        parsed = store.write_all(kept, "parsed_{}")
    crm = next(name for name, source in mapping.items() if source["entity"] == CUSTOMER)
    known = parsed[crm].select(KEY).filter(F.col(KEY).isNotNull()).distinct()
    unknown = {name: unknown_keys(rows, known) for name, rows in parsed.items() if name != crm}
    if store:
        unknown = store.write_all(unknown, "unknown_{}")

    sources = {}
    for name, source in mapping.items():
        rows, keys, count, orphans = parsed[name], unknown.get(name), None, 0
        if store and keys is not None:
            count, orphans = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if keys is None:
            rows = rows.withColumn(_ORPHAN, F.lit(False))
        elif count is None:
            rows = mark_orphans(rows, keys)
        elif count <= BROADCAST_KEYS:
            rows = mark_few_orphans(rows, keys)
        else:
            rows = mark_many_orphans(rows, keys, count, store, name)
        sources[name] = Source(name, source, rows, _counts(name, source, seen[name].get, orphans) if store else None, count)
    return IngestResult(sources)
