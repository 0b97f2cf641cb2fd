"""A corpus from documents: rules, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``docs``. ``run`` writes each
stage's result to the shared folder and reads it back for the next.

Defined results, for every stage: a null text is the empty text; rows without a
doc_id are judged, kept and counted like others; columns besides doc_id, text and
source are carried through whatever their names; an empty table stays empty. What a
stage makes of equal rows and ties its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowstrata.llm import common, mixing, packing, rules, simhash, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list.

    Equal texts get one verdict and repeated rows stay as many. Texts of fewer than ten words, so null and empty ones, go.
    """
    learned = rules.learn(docs, common.table(spark, sf_dir, "labels"))
    mark = _fresh(docs, "__rules_")
    return rules.judge(docs, learned, prefix=mark).where(F.col(f"{mark}kept")).select(*_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    Equal texts score alike and repeated rows stay as many. Without labels of both kinds nothing goes.
    """
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    score = _fresh(docs, "__score")
    scored = docs.withColumn(score, toxicity.score_column(model, common.text_or_empty("text")))
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies.

    Of a component the row with the smallest doc_id stays (null last), among equal ids the one of the smallest
    row hash; of rows that are equal in all columns, one. Different texts under one id, or without an id, are different documents.
    """
    row, text, node, kept = (_fresh(docs, n) for n in ("__near_row", "__near_text", "__near_node", "__near_kept"))
    rows = docs.withColumns({row: _row_hash(docs), text: simhash.text_key()})
    found = simhash.near_copies(docs).select(F.col("node").alias(node), F.col("root").alias("root"))
    keys = rows.select("doc_id", F.col(row), F.col(text)).join(found, F.col(text) == F.col(node), "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))).alias("first")
    stay = keys.groupBy(F.coalesce("root", text)).agg(first).select(F.col("first.row").alias(kept))
    return rows.join(stay, F.col(row) == F.col(kept), "left_semi").dropDuplicates([row]).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, once or twice, as the sources' targets want them, range-sorted by training position.

    Equal rows are interchangeable: as many copies of them are written as all of them together are taken. Documents without words are never taken.
    """
    row, place, again = (_fresh(docs, n) for n in ("__mix_row", "__mix_position", "__mix_again"))
    rows = docs.withColumn(row, _row_hash(docs))
    taken = mixing.copies(mixing.assign(rows, partial=False, keep=[row]), [row])
    taken = taken.select(F.col(row).alias(again), F.col("position").alias(place))
    return rows.dropDuplicates([row]).join(taken, F.col(row) == F.col(again)).orderBy(place, row).select(*_columns(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 ids. Every row is packed, equal ones each."""
    return packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that is no part of any column's name."""
    while any(name in c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls told from other values."""
    parts = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), c if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType) else F.to_json(F.struct(c))]
    return F.xxhash64(*parts)


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: Learned verdicts, XXH64 fingerprints and tokenization are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.store(docs, f"pipeline-{name}")
    return docs
