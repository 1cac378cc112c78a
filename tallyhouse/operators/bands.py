"""Effective-dated bands: which interval a number falls into, by the table that holds on a day.

Tables come from configuration. Bands that overlap, leave a gap, or are empty are refused when they are loaded. A
look-up is a column expression, a balanced tree of comparisons: with n bands a row is compared about log2(n)
times, in generated code, and nothing is joined.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "lower", "upper"


@dataclass(frozen=True)
class Table:
    """The bands that hold from a day on: ``limits`` between them, ascending, and one outcome more."""

    valid_from: date
    limits: tuple[float, ...]
    outcomes: tuple[str, ...]


@dataclass(frozen=True)
class Bands:
    name: str
    value: str
    closed: str
    tables: tuple[Table, ...]

    def _tree(self, keys: Sequence, leaf: Callable[[int], Column], before: Callable[[object], Column], low: int, high: int) -> Column:
        """The leaf for a value among sorted keys: leaf i lies before key i."""
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        return F.when(before(keys[middle]), self._tree(keys, leaf, before, low, middle)).otherwise(
            self._tree(keys, leaf, before, middle + 1, high)
        )

    def _in_table(self, table: Table, value: Column) -> Column:
        before = (lambda limit: value < F.lit(limit)) if self.closed == LOWER else (lambda limit: value <= F.lit(limit))
        return self._tree(table.limits, lambda at: F.lit(table.outcomes[at]), before, 0, len(table.limits))

    def outcome(self, value: Column, on: Column | None = None) -> Column:
        """What the band of a value says, on a day (a column) or by the latest table. Null for null, for a number
        that is none, and for days before the first table."""
        known = value.isNotNull() & ~F.isnan(value.cast("double"))
        if on is None:
            return F.when(known, self._in_table(self.tables[-1], value))
        starts = [table.valid_from for table in self.tables]
        nothing = F.lit(None).cast("string")
        leaf = lambda at: self._in_table(self.tables[at - 1], value) if at else nothing
        return F.when(known & on.isNotNull(), self._tree(starts, leaf, lambda start: on < F.lit(start), 0, len(starts)))

    def of(self, value: float | None, on: date | None = None) -> str | None:
        """The same for one number, by binary search."""
        if value is None or value != value:
            return None
        at = len(self.tables) if on is None else bisect_right([t.valid_from for t in self.tables], on)
        if not at:
            return None
        table = self.tables[at - 1]
        search = bisect_right if self.closed == LOWER else bisect_left
        return table.outcomes[search(table.limits, value)]


def parse_bands(name: str, config: dict) -> Bands:
    """Bands from their configuration; a ValueError that says what is wrong with them."""
    closed = config.get("closed", LOWER)
    if closed not in (LOWER, UPPER):
        raise ValueError(f"{name}: closed is {closed}, not {LOWER} or {UPPER}")
    tables = [_table(f"{name} from {t['valid_from']}", t) for t in config["tables"]]
    starts = [table.valid_from for table in tables]
    if not tables or sorted(set(starts)) != starts:
        raise ValueError(f"{name}: tables must have ascending days")
    return Bands(name, config["value"], closed, tuple(tables))


def _table(name: str, config: dict) -> Table:
    rows = config["rows"]
    if not rows or rows[0].get("from") is not None or rows[-1].get("to") is not None:
        raise ValueError(f"{name}: the outermost bands must have no end")
    limits = []
    for one, other in zip(rows, rows[1:]):
        end, start = one.get("to"), other.get("from")
        if end is None or start is None or end != start:
            kind = "overlap" if end is None or start is None or end > start else "leave a gap"
            raise ValueError(f"{name}: bands {one['is']} and {other['is']} {kind}")
        limits.append(end)
    if any(low >= high for low, high in zip(limits, limits[1:])):
        raise ValueError(f"{name}: a band is empty")
    return Table(config["valid_from"], tuple(limits), tuple(str(row["is"]) for row in rows))
