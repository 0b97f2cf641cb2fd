"""Statistics of row groups: minima, maxima, NULL flags, distinct estimates.

A statistics table has a row per (row group, column); verdicts of filters on it
prune row groups. Everything is one aggregation with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import FilterSet, Verdict, ZoneColumns, ZoneStats

ROW_GROUP = 122_880
PREFIX = 8


def row_group(rowid: Column, rows: int = ROW_GROUP) -> Column:
    return F.floor(rowid / rows).cast("long")


def has_order(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampNTZType, T.TimestampType, T.BooleanType))


def has_distinct(kind: T.DataType) -> bool:
    """Nested and boolean columns get no distinct estimate."""
    return not isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.BooleanType, T.VariantType))


def column_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """One row (per group) of statistics of a column; a path such as ``s.a`` names a struct field."""
    c = F.col(column)
    kind = df.select(c).schema[0].dataType
    aggs = [F.count("*").alias("row_count"), F.coalesce(F.max(c.isNull()), F.lit(False)).alias("has_null"), F.coalesce(F.max(c.isNotNull()), F.lit(False)).alias("has_no_null")]
    if has_order(kind):
        aggs += [F.min(c).alias("min_value"), F.max(c).alias("max_value"), ((F.min(c) == F.max(c)) & ~F.max(c.isNull())).alias("is_constant")]
    if isinstance(kind, T.StringType):
        aggs += [F.min(F.substring(c, 1, PREFIX)).alias("min_prefix"), F.max(F.substring(c, 1, PREFIX)).alias("max_prefix"), F.max(F.octet_length(c)).cast("long").alias("max_bytes"), F.coalesce(F.max(F.length(c) != F.octet_length(c)), F.lit(False)).alias("has_unicode")]
    if has_distinct(kind):
        aggs.append(F.approx_count_distinct(c).alias("approx_distinct"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def table_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: counts, minima and maxima as text, NULL flags. One pass over the table."""
    names = columns or [f.name for f in df.schema if has_order(f.dataType)]
    aggs = []
    for n in names:
        c = F.col(n)
        aggs.append(F.struct(F.lit(n).alias("column_name"), F.count("*").alias("row_count"), F.count(c).alias("value_count"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value")).alias(n))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(n) for n in names])).alias("s")).select("s.*")


def merge_stats(stats: DataFrame) -> DataFrame:
    """Statistics of row groups merged into those of the table."""
    return stats.agg(F.sum("row_count").alias("row_count"), F.max("has_null").alias("has_null"), F.max("has_no_null").alias("has_no_null"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def zone_map(df: DataFrame, columns: list[str], rowid: str = "__rowid", rows: int = ROW_GROUP) -> DataFrame:
    """(rg, row_count, <column>: struct(low, high, has_null, has_value)): one row per row group."""
    aggs = []
    for n in columns:
        c = F.col(n)
        aggs.append(F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.max(c.isNull()).alias("has_null"), F.max(c.isNotNull()).alias("has_value")).alias(n))
    return df.withColumn("rg", row_group(F.col(rowid), rows)).groupBy("rg").agg(F.count("*").alias("row_count"), *aggs)


def verdicts(zones: DataFrame, filters: FilterSet) -> dict[int, Verdict]:
    """The verdict on every row group; the zone map is small: a row per 122,880 rows."""
    names = [c for c in zones.columns if c not in ("rg", "row_count")]
    out = {}
    for r in zones.toLocalIterator():
        stats: Mapping[str, ZoneStats] = {n: ZoneStats(r[n]["low"], r[n]["high"], r[n]["has_null"], r[n]["has_value"]) for n in names}
        out[r["rg"]] = filters.check(stats)
    return out


# ---- stored statistics: a row per zone of 2 ** bits positions, made when the files are written ----------

#: Longer texts are no bounds: such a column has none in its zone.
LONGEST_BOUND = 256
#: Sketches of 2 ** 10 registers: a kilobyte, about 3 % off.
SKETCH = 10


def zones(df: DataFrame, columns: list[str], at: str, bits: int) -> DataFrame:
    """(zone, rows, <column>: struct(low, high, values, sketch)) by the positions in column ``at``.

    The files hold their rows by position, so a task meets few zones and keeps them in a hash table.
    """
    aggs = []
    for n in columns:
        c = F.col(n)
        low, high = F.min(c), F.max(c)
        if isinstance(df.schema[n].dataType, T.StringType):
            short = F.octet_length(low) <= LONGEST_BOUND
            short &= F.octet_length(high) <= LONGEST_BOUND
            low, high = F.when(short, low), F.when(short, high)
        sketch = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(SKETCH))
        aggs.append(F.struct(low.alias("low"), high.alias("high"), F.count(c).alias("values"), sketch.alias("sketch")).alias(n))
    return df.groupBy(F.shiftright(at, bits).alias("zone")).agg(F.count("*").alias("rows"), *aggs)


def zone_summary(stored: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Zones merged into a row per column, named by ``names``: counts, bounds as text, distinct estimate.

    Bounds are NULL where a zone that holds values has none.
    """
    columns = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(f"{i}.values"), F.lit(0)).alias("value_count"),
            *[F.when(~F.max((F.col(f"{i}.values") > 0) & F.col(f"{i}.low").isNull()), best(f"{i}.{end}")).cast("string").alias(f"{end}_value") for end, best in (("low", F.min), ("high", F.max))],
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{i}.sketch")), F.lit(0)).alias("approx_distinct"),
        ).alias(i)
        for i, name in names.items()
    ]
    merged = stored.agg(*columns).select(F.explode(F.array(*[F.col(i) for i in names])).alias("s"))
    return merged.select("s.column_name", "s.row_count", "s.value_count", F.col("s.low_value").alias("min_value"), F.col("s.high_value").alias("max_value"), "s.approx_distinct")


def zones_kept(stored: DataFrame, filters: FilterSet) -> DataFrame:
    """The zones that may hold matching rows."""
    for name, f in filters:
        kind = stored.schema[name].dataType["low"].dataType
        stored = stored.where(f.may(ZoneColumns(*[F.col(f"{name}.{s}") for s in ("low", "high", "values")], F.col("rows"), kind)))
    return stored.select("zone")


def in_zones(df: DataFrame, kept: DataFrame, at: str, bits: int) -> DataFrame:
    """The rows of the kept zones. Few zones become ranges, which reach the files; many are looked up within their span."""
    few = sorted(r[0] for r in kept.limit(MOST_RANGES + 1).collect())
    if len(few) <= MOST_RANGES:
        return df.where(_any([F.col(at).between(a << bits, (b << bits) - 1) for a, b in _runs(few)]))
    low, high = kept.agg(F.min("zone"), F.max("zone")).first()
    df = df.where(F.col(at).between(low << bits, ((high + 1) << bits) - 1))
    return df.join(kept.withColumnRenamed("zone", "__zone"), F.shiftright(at, bits) == F.col("__zone"), "left_semi")


#: Zones that a bound on the first rows of an order is looked for in.
BOUND_ZONES = 10_000


def order_bound(stored: DataFrame, column: str, rows: int, descending: bool) -> object:
    """A value that the first ``rows`` rows of the order all reach; None where the statistics name none.

    Zones are taken by their farther end, best first, until they hold that many values.
    """
    end = F.col(f"{column}.low") if descending else F.col(f"{column}.high")
    zones_ = stored.select(end.alias("end"), F.col(f"{column}.values").alias("n")).where("end IS NOT NULL")
    seen = 0
    for z in zones_.orderBy(F.desc("end") if descending else F.asc("end")).limit(min(rows, BOUND_ZONES)).collect():
        seen += z["n"]
        if seen >= rows:
            return z["end"]
    return None


def _runs(numbers: list[int]) -> list[list[int]]:
    """Sorted numbers as half-open runs."""
    runs: list[list[int]] = []
    for n in numbers:
        if runs and runs[-1][1] == n:
            runs[-1][1] = n + 1
        else:
            runs.append([n, n + 1])
    return runs


#: Ranges of row ids that are tested one by one; more are looked up.
MOST_RANGES = 100


def _any(tests: list[Column]) -> Column:
    """OR of the tests, as a balanced tree."""
    if len(tests) <= 1:
        return tests[0] if tests else F.lit(False)
    half = len(tests) // 2
    return _any(tests[:half]) | _any(tests[half:])


def pruned_scan(df: DataFrame, zones: DataFrame, filters: FilterSet, rowid: str = "__rowid", rows: int = ROW_GROUP) -> DataFrame:
    """The filtered rows of the row groups that may hold any, as ranges of row ids."""
    keep = sorted(rg for rg, v in verdicts(zones, filters).items() if v is not Verdict.NEVER)
    ranges = _runs(keep)
    if len(ranges) <= MOST_RANGES:
        out = df.where(_any([F.col(rowid).between(a * rows, b * rows - 1) for a, b in ranges]))
    else:
        kept = df.sparkSession.createDataFrame([(rg,) for rg in keep], "__kept long")
        out = df.join(kept, row_group(F.col(rowid), rows) == F.col("__kept"), "left_semi")
    for name, f in filters:
        out = out.where(f.column(F.col(name)))
    return out
