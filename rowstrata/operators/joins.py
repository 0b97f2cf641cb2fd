"""Joins beyond the plain ones: as-of and range joins, as plans that partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stretches of time that an as-of join cuts every key into.
STRETCHES = 64


def _stretch(time: Column, cuts: list, first: int = 0) -> Column:
    """How many cuts lie at or before a time, as a balanced tree of comparisons; none for NULL."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(time >= F.lit(cuts[half]), _stretch(time, cuts[half + 1 :], first + half + 1)).otherwise(_stretch(time, cuts[:half], first))


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str, stretches: int = STRETCHES) -> DataFrame:
    """Each left row with the latest right ``value`` at or before its time; of equal times, the greatest value.

    Right rows without key, time or value match nothing, left rows without key or time get NULL. A union and a
    running last value; no pairs are made. A key may hold most of the rows, so time is cut into stretches at its
    quantiles: rows run within a key's stretch, and the last values of the stretches before come from a table
    with a row per key and stretch.
    """
    known = right.select(by, on, value).where(F.col(by).isNotNull() & F.col(on).isNotNull() & F.col(value).isNotNull())
    times = left.select(on).unionByName(known.select(on))
    cuts = times.agg(F.percentile_approx(on, [i / stretches for i in range(1, stretches)], 1000)).first()[0] if stretches > 1 else None
    both = left.withColumn("__left", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(
        known.withColumn("__left", F.lit(0)), allowMissingColumns=True
    )
    both = both.withColumn("__stretch", _stretch(F.col(on), sorted(set(cuts or []))))
    last = both.groupBy(F.col(by).alias("__by"), F.col("__stretch").alias("__at")).agg(F.max(F.when(F.col("__left") == 0, F.struct(on, value)))[value].alias("__last"))
    before = Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__by", "__at", F.last("__last", ignorenulls=True).over(before).alias("__carried")).where("__carried IS NOT NULL")
    order = Window.partitionBy(by, "__stretch").orderBy(on, "__left", value).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("__left = 1")
    both = both.join(carried, (F.col(by) == F.col("__by")) & (F.col("__stretch") == F.col("__at")), "left")
    found = F.when(F.col(on).isNotNull(), F.coalesce(value, "__carried"))
    return both.withColumn(value, found).drop("__left", "__stretch", "__by", "__at", "__carried")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them: an equi-join on cells of ``width``."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__cell", F.floor(F.col(point) / width)).join(cells, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")
