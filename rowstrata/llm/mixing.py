"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight (5, 2, 1, repeating, over the sources in code point
order, null last) that fixes its share of the token budget, and a schedule: a
piecewise linear weight over training time 0..1. The schedule is integrated in
closed form, the cumulative demand of a source is inverted to give each copy of
a document its training position, and documents are range-sorted by position.

Defined results: null and wordless texts have size 0, are never taken and have
no position; a source of size 0 has target 0; equal rows are interchangeable;
an empty table gives an empty mix; extra columns are ignored. All order comes
from MD5 of doc_id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Shares of consecutive sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules of consecutive sources, repeating: knots (time, weight) from 0 to 1.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 3.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.6, 1.0), (1.0, 4.0)),
)
BUDGET = 1.5
MOST_PASSES = 2.0


def areas(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The integral of a piecewise linear schedule from 0 to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def inverse(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` (0..1) of the schedule's integral is spent."""
    spent = areas(knots)
    need = share * F.lit(spent[-1])
    out = F.lit(float(knots[-1][0]))
    for (t0, w0), (t1, w1), a0, a1 in reversed(list(zip(knots, knots[1:], spent, spent[1:]))):
        slope = (w1 - w0) / (t1 - t0)
        rest = need - F.lit(a0)
        # w0 x + slope x^2 / 2 = rest, in the form that is stable for small slopes
        x = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        out = F.when(need <= a1, F.least(F.lit(t1), F.lit(t0) + x)).otherwise(out)
    return out


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, passes: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, rank, target) from rows of (source, size).

    The budget is shared by weight; a target stops at ``passes`` times its
    source's size and the excess is reshared. In closed form: with sources by
    cap per weight, the capped ones are a prefix, and the level of the rest is
    the first that does not reach the next cap. The table has one row per
    source, so its windows are small.
    """
    per = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(passes) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    prior, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(budget))
    per = per.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / F.sum("w").over(rest))
    per = per.withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("rank"), F.col("level")))).over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("final", first)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final")["level"] * F.col("w")))
    return per.select("source", "source_size", "rank", target.alias("target"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partial: bool = True, schedules=SCHEDULES, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, passes: float = MOST_PASSES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: size, source_size, target, and take and position of each of the ``passes``.

    ``keep`` names columns that are carried along.

    A source's documents are laid end to end in hash order, pass after pass,
    until its target is spent. ``partial`` cuts the document at the end of the
    demand to the words still wanted; otherwise it is taken whole if more than
    half of it is wanted.
    """
    if passes != int(passes) or passes < 1:
        raise ValueError("a document is taken a whole number of times")
    carried = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), common.word_count(F.col(text_col)).alias("size"), *carried)
    sized = common.store(sized.withColumn("key", common.md5_key(F.col("doc_id").cast("string"))), "mix-sized")
    laid = common.bucketed_prefix(sized, ["source"], "key", ["doc_id", "size", *(f"__keep{i}" for i in range(len(keep)))], "size", "lead", "mix")
    per = source_targets(sized, weights, budget, passes)
    rows = laid.alias("d").join(per.withColumnRenamed("source", "s"), F.col("d.source").eqNullSafe(F.col("s"))).drop("s")
    demand = F.round("target").cast("long")

    def take(start: Column) -> Column:
        if partial:
            return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - start))
        return F.when(demand - start > F.col("size") / 2, F.col("size")).otherwise(F.lit(0).cast("long"))

    def position(start: Column, took: Column) -> Column:
        share = F.least(F.lit(1.0), F.try_divide(start + took / 2, F.col("target")))
        by = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            by = F.when(F.col("rank") % len(schedules) == i, inverse(share, knots)).otherwise(by)
        return F.when(took > 0, by)

    starts = {k: F.col("lead") + (k - 1) * F.col("source_size") for k in range(1, int(passes) + 1)}
    rows = rows.withColumns({f"take{k}": take(start) for k, start in starts.items()})
    places = [position(start, F.col(f"take{k}")).alias(f"position{k}") for k, start in starts.items()]
    return rows.select("doc_id", "source", "size", "source_size", "target", *(f"take{k}" for k in starts), *places, *(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)))


def copies(assigned: DataFrame, columns: Sequence[str] = ("doc_id", "source"), passes: int = int(MOST_PASSES)) -> DataFrame:
    """(columns, copy, words, position) of the copies that ``assign`` takes."""
    each = F.array(*(F.struct(F.lit(k).alias("copy"), F.col(f"take{k}").alias("words"), F.col(f"position{k}").alias("position")) for k in range(1, passes + 1)))
    return assigned.select(*columns, F.explode(each).alias("__c")).select(*columns, "__c.*").where("words > 0")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, copy, words, position): the copies to train on, range-sorted by position."""
    return copies(assign(docs, **options), passes=int(options.get("passes", MOST_PASSES))).orderBy("position", "doc_id", "copy")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row each, range-sorted by first training position.

    position1 and position2 are the training times (0 to 1) of its first and second copy, null for one that isn't taken.
    """
    rows = assign(common.table(spark, sf_dir, "documents"))
    rows = rows.withColumn("taken", F.col("take1") + F.col("take2")).orderBy(F.col("position1").asc_nulls_last(), "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", *(F.round(f"position{k}", 9).alias(f"position{k}") for k in (1, 2)))


_SIZED = r"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents)"""

def _inverse_sql(share: str) -> str:
    """The schedules' inverse as SQL, piece by piece."""
    out = []
    for i, knots in enumerate(SCHEDULES):
        spent, pieces = areas(knots), []
        for (t0, w0), (t1, w1), a0, a1 in zip(knots, knots[1:], spent, spent[1:]):
            rest = f"({share} * {spent[-1]!r}::DOUBLE - {a0!r}::DOUBLE)"
            x = f"2 * {rest} / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + 2 * {(w1 - w0) / (t1 - t0)!r}::DOUBLE * {rest}, 0)))"
            pieces.append(f"WHEN {share} * {spent[-1]!r}::DOUBLE <= {a1!r}::DOUBLE THEN least({t1!r}::DOUBLE, {t0!r}::DOUBLE + {x})")
        out.append(f"WHEN {i} THEN CASE {' '.join(pieces)} ELSE {float(knots[-1][0])!r}::DOUBLE END")
    return f"CASE rank % {len(SCHEDULES)} {' '.join(out)} END"


OP2_SQL = (
    "WITH"
    + _SIZED
    + """,
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM per),
levelled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
water AS (SELECT level FROM levelled WHERE level <= cap / w ORDER BY cap / w, rank LIMIT 1),
targets AS (SELECT source, source_size, rank, least(cap, coalesce((SELECT level FROM water) * w, cap)) AS target FROM levelled),
laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead FROM sized)
SELECT doc_id, size, source_size, target, (take1 + take2)::BIGINT AS taken,
       """
    + ",\n       ".join(f"CASE WHEN take{k} > 0 THEN round({_inverse_sql(f'least(1.0, (lead + {k - 1} * source_size + take{k} / 2.0) / target)')}, 9) END AS position{k}" for k in (1, 2))
    + """
FROM (SELECT *, greatest(0, least(size, round(target)::BIGINT - lead))::BIGINT AS take1, greatest(0, least(size, round(target)::BIGINT - lead - source_size))::BIGINT AS take2
      FROM (SELECT laid.*, source_size, target, rank FROM laid JOIN targets ON laid.source IS NOT DISTINCT FROM targets.source))
"""
)
