"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each level every child draws
-ln(u)/weight with u hashed from the key and the child's name, and the smallest
draw wins: children are chosen in proportion to their weights, and a change of
weights moves keys only below the node whose children changed. A shard added as
a new region at the root therefore takes keys only into itself.

Law ``key``: doc_id and shard count alone decide. Defined results: rows with
equal doc_id share a shard, a null doc_id counts as the empty key, a null text
has no bytes; slots within a shard run from 0 in hash order; extra columns are
ignored and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
SHARDS, REGION_RACKS, RACK_SHARDS = 40, 4, 5


def topology(shards: int = SHARDS, base: int = SHARDS) -> dict[str, dict[str, dict[int, float]]]:
    """``base`` shards in racks of 5 and regions of 4 racks; each shard beyond them is a region of its own."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(min(shards, base)):
        rack = s // RACK_SHARDS
        tree.setdefault(f"region{rack // REGION_RACKS}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    for s in range(base, shards):
        tree[f"annex{s}"] = {f"annexrack{s}": {s: 1.0}}
    return tree


def levels(tree: Tree) -> tuple[list[tuple[str, float]], dict[str, list[tuple[str, float]]], dict[str, list[tuple[str, float]]]]:
    """Children with weights: of the root, of each region, of each rack. A node weighs what hangs below it."""
    rack_of = {r: [(k, float(sum(s.values()))) for k, s in racks.items()] for r, racks in tree.items()}
    shard_of = {k: [(f"shard{i}", float(w)) for i, w in s.items()] for racks in tree.values() for k, s in racks.items()}
    return [(r, sum(w for _, w in kids)) for r, kids in rack_of.items()], rack_of, shard_of


def draw(key: Column, name: str, weight: float) -> Column:
    """The draw of a child: an exponential variate with its weight as rate."""
    u = (common.md5_key(key, F.lit(name)) + F.lit(1)).cast("double") / F.lit(float(1 << common.KEY_BITS) + 1.0)
    return -F.ln(u) / F.lit(weight)


def choose(key: Column, children: list[tuple[str, float]]) -> Column:
    live = [(n, w) for n, w in children if w > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(F.array(*(F.struct(draw(key, n, w).alias("d"), F.lit(n).alias("n")) for n, w in live)))["n"]


def place(df: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """Add ``out``, the shard of each row. Only the chosen subtree's draws are computed."""
    root, rack_of, shard_of = levels(tree)
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, choose(key, root))

    def below(column: str, kids: Mapping[str, list[tuple[str, float]]]) -> Column:
        got = F.lit(None).cast("string")
        for name, children in kids.items():
            if any(w > 0 for _, w in children):
                got = F.when(F.col(column) == name, choose(key, children)).otherwise(got)
        return got

    df = df.withColumn(rack, below(region, rack_of))
    return df.withColumn(out, F.substring(below(rack, shard_of), len("shard") + 1, 12).cast("int")).drop(region, rack)


def shard_documents(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), slots gapless from 0 in each shard."""
    body = common.text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = place(rows.withColumn("key", common.md5_key(key)).withColumn("one", F.lit(1).cast("long")), key, tree, "shard")
    rows = common.store(rows, "shards")
    return common.bucketed_prefix(rows, ["shard"], "key", ["doc_id", "size", "text_crc32"], "one", "slot", "slot").drop("key", "one")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``key``, and their shard of 41."""
    rows = shard_documents(common.table(spark, sf_dir, "documents"), topology(SHARDS))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = place(rows, key, topology(SHARDS + 1), "grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _placed_sql(tree: Tree, table: str, out: str) -> str:
    """SQL that adds ``out`` to ``table`` (with a column ``k``), level by level."""
    root, rack_of, shard_of = levels(tree)

    def pick(children: list[tuple[str, float]]) -> str:
        draws = ", ".join(f"{{'d': -ln((('0x' || substr(md5(k || ':{n}'), 1, 15))::BIGINT + 1)::DOUBLE / 1152921504606846977.0::DOUBLE) / {w}::DOUBLE, 'n': '{n}'}}" for n, w in children)
        return f"list_sort([{draws}])[1].n"

    def cases(column: str, kids: Mapping[str, list[tuple[str, float]]]) -> str:
        return "CASE " + " ".join(f"WHEN {column} = '{n}' THEN {pick(c)}" for n, c in kids.items()) + " END"

    return (
        f"SELECT * EXCLUDE (region, rack, leaf), replace(leaf, 'shard', '')::INT AS {out} FROM (SELECT *, {cases('rack', shard_of)} AS leaf FROM "
        f"(SELECT *, {cases('region', rack_of)} AS rack FROM (SELECT *, {pick(root)} AS region FROM {table})))"
    )


def op5_sql() -> str:
    """The query in DuckDB SQL. CRC-32, which DuckDB lacks, folds the bytes over a table made by its rule (polynomial 0xEDB88320)."""
    crc = """
      WITH crc_table AS (SELECT list(x ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(i))),
      body AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
      a AS (SELECT doc_id, (len(bytes) + 16)::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS k,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32 FROM body, crc_table)"""
    return (
        f"{crc}, b AS ({_placed_sql(topology(SHARDS), 'a', 'shard')}), c AS ({_placed_sql(topology(SHARDS + 1), 'b', 'grown_shard')}) "
        "SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 15))::BIGINT, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM c"
    )
