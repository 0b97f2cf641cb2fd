"""Scan requests: columns in the order asked for, and filters on any column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import Filter, FilterSet


class ScanRequest:
    """Which columns to return, and which rows. Filtered columns need not be returned.

    ``apply`` declares filter below projection, so both reach the file scan.
    """

    def __init__(self, columns: Sequence[str | int] | None = None) -> None:
        self.columns = list(columns or [])
        self.filters = FilterSet()
        self.fraction: float | None = None
        self.seed: int | None = None

    def sample(self, fraction: float, seed: int | None = None) -> ScanRequest:
        """Return about this share of the matching rows."""
        if not 0 <= fraction <= 1:
            raise ValueError("a share lies between 0 and 1")
        self.fraction, self.seed = fraction, seed
        return self

    def push_filter(self, column: str, new: Filter) -> ScanRequest:
        self.filters.push(column, new)
        return self

    def names(self, df: DataFrame) -> list[str]:
        """The returned columns, by name or position; none means all."""
        known = {c.lower(): c for c in df.columns}
        out = []
        for c in self.columns or df.columns:
            name = df.columns[c] if isinstance(c, int) else known.get(c.lower())
            if name is None:
                raise KeyError(f"no column {c!r}{did_you_mean(c, df.columns)}")
            out.append(name)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        known = {c.lower(): c for c in df.columns}
        columns = self.names(df)
        for name, f in self.filters:
            if name.lower() not in known:
                raise KeyError(f"no column {name!r}{did_you_mean(name, df.columns)}")
            df = df.where(f.column(F.col(f"`{known[name.lower()]}`")))
        df = df.select(*[f"`{c}`" for c in columns])
        return df if self.fraction is None else df.sample(self.fraction, self.seed)

    def sql(self, table: str) -> str:
        return f"SELECT {', '.join(map(str, self.columns)) or '*'} FROM {table} WHERE {self.filters.sql()}"


def did_you_mean(name: str, known: Sequence[str]) -> str:
    import difflib

    near = difflib.get_close_matches(name.lower(), [k.lower() for k in known], 1)
    return f"; did you mean {near[0]!r}?" if near else ""
