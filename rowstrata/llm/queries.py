"""Queries over the whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, media, mixing, packing, quality, rules, sharding, simhash, toxicity, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.op1_media,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_warc": warc.op4_warc,
    "op5_sharding": sharding.op5_sharding,
    "op6_chat": chat.op6_chat,
    "op7_rules": rules.op7_rules,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.OP2_SQL, "op4_warc": warc.OP4_SQL, "op5_sharding": sharding.op5_sql(), "op6_chat": chat.OP6_SQL}
