"""Chunk algebra on DataFrames: reference, slice, append, copy, split, fuse, sequence, constant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reference_columns(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in positions])


def slice_rows(df: DataFrame, order: Sequence[str], offset: int, count: int) -> DataFrame:
    """Rows offset .. offset+count of an order; without one, rows have no positions."""
    return df.orderBy(*order).offset(offset).limit(count)


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other)


def copy_rows(df: DataFrame, position: str, offset: int = 0, selection: DataFrame | None = None) -> DataFrame:
    """Rows from ``offset`` on of a position column or, by a selection of (slot, position), a row for each slot from ``offset`` on."""
    if selection is None:
        return df.where(F.col(position) >= offset)
    slot, wanted = selection.columns
    chosen = selection.where(F.col(slot) >= offset).select(F.col(wanted).alias("__wanted"))
    return df.join(chosen, F.col(position) == F.col("__wanted")).drop("__wanted")


def split_columns(df: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    return df.select(*df.columns[:at]), df.select(*df.columns[at:])


def fuse(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Columns side by side, rows matched by key."""
    return left.join(right, list(on))


def sequence(spark: SparkSession, start: int, count: int, increment: int = 1, name: str = "value") -> DataFrame:
    return spark.range(count).select((F.lit(start) + F.col("id") * increment).cast("long").alias(name))


def constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def union(left: DataFrame, right: DataFrame, kind: str = "all") -> DataFrame:
    """UNION ALL, UNION, INTERSECT or EXCEPT."""
    return {"all": left.unionByName, "distinct": lambda o: left.unionByName(o).distinct(), "intersect": left.intersect, "except": left.subtract}[kind](right)
