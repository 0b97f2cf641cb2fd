"""Filters on columns: a small tree that becomes a Spark column, SQL text, or a
verdict on the statistics of a row group."""

from __future__ import annotations

import datetime
import decimal
import enum
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Verdict(enum.Enum):
    """What the statistics of a row group say of a filter on it."""

    NEVER = "always false"
    MAYBE = "no pruning"
    ALWAYS = "always true"


@dataclass(frozen=True)
class ZoneStats:
    """Statistics of one column in one row group. ``children`` are those of struct fields."""

    low: object = None
    high: object = None
    has_null: bool = True
    has_value: bool = True
    children: Mapping[str, ZoneStats] | None = None


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex().upper()}'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value}'"
    if isinstance(value, float):
        return repr(value) if value == value and abs(value) != float("inf") else f"CAST('{value}' AS DOUBLE)"
    return str(value)


def _number(value: object) -> bool:
    return isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)


def _kind(value: object) -> type:
    return float if _number(value) else type(value)


def _comparable(stats: ZoneStats, value: object) -> bool:
    """NaN orders above all numbers in SQL but not in Python: statistics with it prune nothing."""
    known = stats.low is not None and stats.high is not None
    return known and _kind(stats.low) is _kind(value) and not any(isinstance(x, float) and x != x for x in (stats.low, stats.high, value))


@dataclass(frozen=True)
class ZoneColumns:
    """Stored statistics of one column as columns, a row per zone. Bounds are NULL where none are known."""

    low: Column
    high: Column
    values: Column
    rows: Column
    kind: T.DataType

    def bounds(self, value: object) -> bool:
        """Whether values of this Python type order as the stored ones do."""
        if _number(value):
            return isinstance(self.kind, T.NumericType)
        return isinstance(self.kind, {str: T.StringType, datetime.date: T.DateType, bool: T.BooleanType}.get(type(value), ()))


class Filter:
    def column(self, col: Column) -> Column:
        raise NotImplementedError

    def may(self, zone: ZoneColumns) -> Column:
        """Whether a zone may hold a row that matches; where nothing tells, true."""
        return F.lit(True)

    def sql(self, name: str) -> str:
        raise NotImplementedError

    def check(self, stats: ZoneStats) -> Verdict:
        raise NotImplementedError


OPERATORS = ("=", "!=", ">", ">=", "<", "<=")


@dataclass(frozen=True)
class Compare(Filter):
    """``column op constant``; NULLs never match."""

    op: str
    value: object

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown comparison {self.op!r}")
        if self.value is None:
            raise ValueError("a comparison with NULL never holds; use IsNull")

    def column(self, col: Column) -> Column:
        v = F.lit(self.value)
        return {"=": col == v, "!=": col != v, ">": col > v, ">=": col >= v, "<": col < v, "<=": col <= v}[self.op]

    def may(self, zone: ZoneColumns) -> Column:
        if not zone.bounds(self.value):
            return zone.values > 0
        low, high, v = zone.low, zone.high, F.lit(self.value)
        got = {"=": (low <= v) & (high >= v), "!=": ~((low == v) & (high == v)), ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}[self.op]
        return (zone.values > 0) & F.coalesce(got, F.lit(True))

    def sql(self, name: str) -> str:
        return f"{name} {'<>' if self.op == '!=' else self.op} {literal(self.value)}"

    def check(self, stats: ZoneStats) -> Verdict:
        if not stats.has_value:
            return Verdict.NEVER
        if not _comparable(stats, self.value):
            return Verdict.MAYBE
        low, high, v = stats.low, stats.high, self.value
        never, always = {
            "=": (v < low or v > high, low == high == v), "!=": (low == high == v, v < low or v > high), ">": (high <= v, low > v), ">=": (high < v, low >= v), "<": (low >= v, high < v), "<=": (low > v, high <= v),
        }[self.op]
        return Verdict.NEVER if never else Verdict.ALWAYS if always and not stats.has_null else Verdict.MAYBE


@dataclass(frozen=True)
class In(Filter):
    values: tuple

    def __init__(self, values) -> None:
        values = tuple(values)
        if not values:
            raise ValueError("IN asks for a value at least")
        if any(v is None for v in values):
            raise ValueError("IN takes no NULL")
        if len({_kind(v) for v in values}) > 1:
            raise ValueError("the values of IN are of different types")
        object.__setattr__(self, "values", values)

    def column(self, col: Column) -> Column:
        return col.isin(*self.values)

    def may(self, zone: ZoneColumns) -> Column:
        return Or(tuple(Compare("=", v) for v in self.values)).may(zone)

    def sql(self, name: str) -> str:
        return f"{name} IN ({', '.join(map(literal, self.values))})"

    def check(self, stats: ZoneStats) -> Verdict:
        return Or(tuple(Compare("=", v) for v in self.values)).check(stats)


@dataclass(frozen=True)
class IsNull(Filter):
    def column(self, col: Column) -> Column:
        return col.isNull()

    def may(self, zone: ZoneColumns) -> Column:
        return zone.values < zone.rows

    def sql(self, name: str) -> str:
        return f"{name} IS NULL"

    def check(self, stats: ZoneStats) -> Verdict:
        return Verdict.NEVER if not stats.has_null else Verdict.MAYBE if stats.has_value else Verdict.ALWAYS


@dataclass(frozen=True)
class IsNotNull(Filter):
    def column(self, col: Column) -> Column:
        return col.isNotNull()

    def may(self, zone: ZoneColumns) -> Column:
        return zone.values > 0

    def sql(self, name: str) -> str:
        return f"{name} IS NOT NULL"

    def check(self, stats: ZoneStats) -> Verdict:
        return Verdict.NEVER if not stats.has_value else Verdict.MAYBE if stats.has_null else Verdict.ALWAYS


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]

    def column(self, col: Column) -> Column:
        out = self.parts[0].column(col)
        for p in self.parts[1:]:
            out = out & p.column(col)
        return out

    def may(self, zone: ZoneColumns) -> Column:
        out = self.parts[0].may(zone)
        for p in self.parts[1:]:
            out = out & p.may(zone)
        return out

    def sql(self, name: str) -> str:
        return "(" + " AND ".join(p.sql(name) for p in self.parts) + ")"

    def check(self, stats: ZoneStats) -> Verdict:
        got = {p.check(stats) for p in self.parts}
        return Verdict.NEVER if Verdict.NEVER in got else Verdict.ALWAYS if got == {Verdict.ALWAYS} else Verdict.MAYBE


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]

    def column(self, col: Column) -> Column:
        out = self.parts[0].column(col)
        for p in self.parts[1:]:
            out = out | p.column(col)
        return out

    def may(self, zone: ZoneColumns) -> Column:
        out = self.parts[0].may(zone)
        for p in self.parts[1:]:
            out = out | p.may(zone)
        return out

    def sql(self, name: str) -> str:
        return "(" + " OR ".join(p.sql(name) for p in self.parts) + ")"

    def check(self, stats: ZoneStats) -> Verdict:
        got = {p.check(stats) for p in self.parts}
        return Verdict.ALWAYS if Verdict.ALWAYS in got else Verdict.NEVER if got == {Verdict.NEVER} else Verdict.MAYBE


@dataclass(frozen=True)
class Field(Filter):
    """A filter on a field of a struct column."""

    name: str
    inner: Filter

    def column(self, col: Column) -> Column:
        return self.inner.column(col.getField(self.name))

    def sql(self, name: str) -> str:
        return self.inner.sql(f"{name}.{self.name}")

    def check(self, stats: ZoneStats) -> Verdict:
        child = (stats.children or {}).get(self.name)
        return Verdict.MAYBE if child is None else self.inner.check(child)


@dataclass(frozen=True)
class Prefix(Filter):
    """Strings that begin with ``text``."""

    text: str

    def column(self, col: Column) -> Column:
        return col.startswith(self.text)

    def may(self, zone: ZoneColumns) -> Column:
        if not zone.bounds(self.text):
            return zone.values > 0
        got = (zone.high >= self.text) & (F.substring(zone.low, 1, len(self.text)) <= self.text)
        return (zone.values > 0) & F.coalesce(got, F.lit(True))

    def sql(self, name: str) -> str:
        return f"starts_with({name}, {literal(self.text)})"

    def check(self, stats: ZoneStats) -> Verdict:
        if not stats.has_value:
            return Verdict.NEVER
        if not _comparable(stats, self.text):
            return Verdict.MAYBE
        low, high = stats.low.startswith(self.text), stats.high.startswith(self.text)
        if low and high and not stats.has_null:
            return Verdict.ALWAYS
        return Verdict.NEVER if stats.high < self.text or (stats.low > self.text and not low) else Verdict.MAYBE


class FilterSet:
    """Filters by column name; several on one column are joined by AND."""

    def __init__(self, filters: Mapping[str, Filter] | None = None) -> None:
        self._by: dict[str, Filter] = dict(filters or {})

    def push(self, column: str, new: Filter) -> FilterSet:
        old = self._by.get(column)
        if old is None:
            self._by[column] = new
        else:
            self._by[column] = And((*old.parts, new) if isinstance(old, And) else (old, new))
        return self

    def get(self, column: str) -> Filter | None:
        return self._by.get(column)

    def set(self, column: str, new: Filter) -> None:
        self._by[column] = new

    def remove(self, column: str) -> None:
        self._by.pop(column, None)

    def clear(self) -> None:
        self._by.clear()

    def copy(self) -> FilterSet:
        return FilterSet(self._by)

    def __iter__(self) -> Iterator[tuple[str, Filter]]:
        return iter(self._by.items())

    def __len__(self) -> int:
        return len(self._by)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FilterSet) and self._by == other._by

    def sql(self) -> str:
        return " AND ".join(f.sql(c) for c, f in self) or "TRUE"

    def check(self, stats: Mapping[str, ZoneStats]) -> Verdict:
        """The verdict for a whole row group; a column without statistics prunes nothing."""
        got = {f.check(stats[c]) if c in stats else Verdict.MAYBE for c, f in self} or {Verdict.ALWAYS}
        return Verdict.NEVER if Verdict.NEVER in got else Verdict.ALWAYS if got == {Verdict.ALWAYS} else Verdict.MAYBE
