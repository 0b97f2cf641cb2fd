"""Functions that engines name differently, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_to_string(col: Column, separator: str) -> Column:
    """The elements as text, NULLs left out."""
    return F.array_join(F.transform(col, lambda x: x.cast("string")), separator)


def list_count(col: Column) -> Column:
    """The number of elements that aren't NULL; NULL for a NULL list."""
    return F.size(F.filter(col, lambda x: x.isNotNull())).cast("long")


def element(col: Column, position: int) -> Column:
    """1-based element; NULL outside the list."""
    return F.try_element_at(col, F.lit(position))


def struct_extract(col: Column, name: str) -> Column:
    return col.getField(name)


def day(number: Column) -> Column:
    """The date of a day number since 1970-01-01."""
    return F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int"))
