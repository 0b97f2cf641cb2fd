"""Helpers shared by the training-data operators.

Conventions all operators keep:

* an operator reads only the columns it is told to read; other columns are
  ignored, or carried through untouched where the operator adds columns;
* a null text is the empty text;
* intermediate tables go to the folder that the session names in
  ``spark.checkpoint.dir``, which every executor and the driver share.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``, as characters.
BLANKS = " \t\n\x0b\x0c\r"
#: A word as a regular expression for Java (and for RE2 in the SQL twins).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="rowstrata-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Bytes of rows that a Python worker gets at once, whatever the length of texts.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Have Spark cut the batches for Python workers by bytes, unless the session says how."""
    spark = spark or SparkSession.getActiveSession()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete what this process put into the shared folder; for when no result is still to be computed from it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: the work before it runs once, and a lost executor
    costs a reread instead of a recomputation. The driver then collects its garbage,
    so that Spark may drop the shuffle files of that work, and the heap that its
    plans and tasks had grown can shrink again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``WORD`` matches: a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_key(*parts: Column) -> Column:
    """A 60-bit order key that SQL engines agree on (leading hex digits of MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


KEY_BITS = 60


def bucketed_prefix(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``key`` (a uniform 60-bit hash) and then ``ties``. A
    group may hold a third of all rows, so no window ever spans one: the key
    range is cut into about sqrt(n)/4 buckets, sums per (group, bucket) are
    pre-aggregated, their prefixes are taken over that small table, and rows
    are ranked within (group, bucket) only.

    ``df`` must be a stored table, since it is read three times.
    """
    n = max(df.count(), 1)
    buckets = max(1, math.ceil(math.sqrt(n) / 4))
    b, before = f"__{label}_bucket", f"__{label}_before"
    df = df.withColumn(b, F.floor(F.col(key) / F.lit(float(1 << KEY_BITS)) * buckets).cast("int"))
    sums = df.groupBy(*group, b).agg(F.sum(value).alias(before))
    prior = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(b).alias("__gb"), F.coalesce(F.sum(before).over(prior), F.lit(0)).alias(before))
    on = F.col(b) == F.col("__gb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*group, b).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, on)
    return joined.withColumn(out, F.col(before) + F.coalesce(F.sum(value).over(within), F.lit(0))).drop(b, before, "__gb", *[f"__g{i}" for i in range(len(group))])


def labelled_sample(labels: DataFrame, column: str, limit: int, held_out_remainder: int | None = 1) -> DataFrame:
    """At most ``limit`` labelled ids with the label ``column``, by hash order.

    Rows whose ``crc32(doc_id as text) mod 3`` is ``held_out_remainder`` are
    left out. The sample is what a classifier learns from; its size is a
    parameter and bounds what reaches the driver.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if held_out_remainder is not None:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != held_out_remainder)
    rows = rows.groupBy("doc_id").agg(F.min(column).alias(column))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def bounded_texts(rows: DataFrame, chars: int) -> tuple[list[str], list[int]]:
    """The texts and labels of (text, label) rows in their order, until so many characters are held.

    Rows come partition by partition, so the driver never holds more than the bound and one partition.
    """
    return first_texts(rows.toLocalIterator(), chars)


def first_texts(rows: Iterable[tuple[str, object]], chars: int) -> tuple[list[str], list[int]]:
    """The texts and labels of (text, label) pairs in their order, until so many characters are held."""
    texts, labels, held = [], [], 0
    for text, label in rows:
        held += len(text)
        if texts and held > chars:
            break
        texts.append(text)
        labels.append(int(label))
    return texts, labels
