"""The queries of this engine, one or more for each operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sql as fn
from .operators import chunks, joins, stats
from .plans.filters import And, Compare, Field, Filter, FilterSet, In, IsNotNull, IsNull, Or, Prefix
from .plans.scan import ScanRequest
from .sources.database import ConflictError
from .sources.scratch import scratch_database
from .streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- scans --------------------------------------------------------------------------------------

LINEITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def request(name: str, base: str, columns: list[str], filters: list[tuple[str, Filter]]) -> None:
    """A scan request on a base table; its SQL comes from the same filter tree."""
    r = ScanRequest(columns)
    for c, f in filters:
        r.push_filter(c, f)
    QUERIES[name] = lambda spark, d: r.apply(table(spark, d, base))
    ORACLE_SQL[name] = r.sql(base)


request("scan_full", "lineitem", [], [])
request("scan_project", "lineitem", ["l_returnflag", "l_orderkey"], [])
request("scan_request", "orders", ["o_orderkey", "o_totalprice"], [("o_orderstatus", Compare("=", "O")), ("o_totalprice", Compare(">", 100000.0))])
request("scan_hidden_filter", "lineitem", ["l_returnflag"], [("l_orderkey", Compare("=", 1))])
request("filter_eq", "lineitem", ["l_orderkey", "l_quantity"], [("l_quantity", Compare("=", 10.0))])
request("filter_ne", "lineitem", ["l_orderkey", "l_returnflag"], [("l_returnflag", Compare("!=", "N"))])
request("filter_gt", "lineitem", ["l_orderkey", "l_extendedprice"], [("l_extendedprice", Compare(">", 50000.0))])
request("filter_ge", "orders", ["o_orderkey", "o_orderpriority"], [("o_orderpriority", Compare(">=", "4"))])
request("filter_lt", "lineitem", ["l_orderkey", "l_discount"], [("l_discount", Compare("<", 0.03))])
request("filter_le", "customer", ["c_custkey", "c_name"], [("c_name", Compare("<=", "Customer#000000500"))])
request("filter_in", "lineitem", ["l_orderkey", "l_suppkey"], [("l_suppkey", In([1, 7, 42]))])
request("filter_and_range", "lineitem", ["l_orderkey"], [("l_orderkey", And((Compare(">", 100), Compare("<", 500))))])
request("filter_or_same_col", "events", ["event_id", "event_type"], [("event_type", Or((Compare("=", "click"), Compare("=", "error"))))])
request("filter_multi_col", "lineitem", ["l_orderkey", "l_linenumber"], [("l_returnflag", Compare("=", "R")), ("l_quantity", Compare(">=", 30.0)), ("l_tax", Compare("<", 0.05))])
request("filter_prefix", "part", ["p_partkey", "p_type"], [("p_type", Prefix("S"))])

_NULLED = "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS status FROM orders"


def _nulled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))


def _null_query(name: str, f: Filter) -> None:
    QUERIES[name] = lambda spark, d: ScanRequest(["o_orderkey", "status"]).push_filter("status", f).apply(_nulled(spark, d))
    ORACLE_SQL[name] = f"SELECT o_orderkey, status FROM ({_NULLED}) WHERE {f.sql('status')}"


_null_query("filter_is_null", IsNull())
_null_query("filter_is_not_null", IsNotNull())
_null_query("filter_null_compare", Compare("!=", "O"))
_null_query("filter_null_in", In(["O", "P"]))


@query("filter_struct_field", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_custkey < 50")
def _(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_totalprice").alias("s"))
    return ScanRequest().push_filter("s", Field("o_custkey", Compare("<", 50))).apply(s).select("o_orderkey", F.col("s.o_totalprice").alias("price"))


@query("scan_parallel_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


# ---- tables with row ids, transactions, alterations -----------------------------------------------

_IDS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS rowid FROM orders"
_COLUMNS = [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"), ("o_totalprice", "DOUBLE")]


def _orders(spark: SparkSession, d: str, **options):
    """A connection to a database of its own with all orders, in key order."""
    con = scratch_database(spark, **options).connect()
    con.create_table("orders", _COLUMNS)
    con.insert("orders", table(spark, d, "orders").select(*[c for c, _ in _COLUMNS]).orderBy("o_orderkey"))
    return con


@query("scan_rowid", f"SELECT o_orderkey, rowid FROM ({_IDS})")
def _(spark, d):
    return _orders(spark, d).scan("orders", rowid=True).select("o_orderkey", "rowid")


@query("scan_rowid_range", f"SELECT o_orderkey, rowid FROM ({_IDS}) WHERE rowid >= 100 AND rowid < 200")
def _(spark, d):
    return _orders(spark, d).scan_range("orders", 100, 200).select("o_orderkey", "rowid")


@query("fetch_by_rowid", f"SELECT o_orderkey, rowid FROM ({_IDS}) WHERE rowid IN (0, 7, 99, 12345678901)")
def _(spark, d):
    return _orders(spark, d).fetch("orders", [0, 7, 99, 12345678901]).select("o_orderkey", "rowid")


@query("scan_in_rowid_order", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def _(spark, d):
    return _orders(spark, d).scan("orders", rowid=True).orderBy("rowid").limit(50).select("o_orderkey")


@query("scan_with_local", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT -1, 1.5 UNION ALL SELECT -2, NULL")
def _(spark, d):
    con = _orders(spark, d)
    con.begin()
    con.insert("orders", [(-1, 1, "O", 1.5), (-2, None, None, None)])
    return con.scan("orders").select("o_orderkey", "o_totalprice")


@query("dml_insert", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'X', o_totalprice FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    more = table(spark, d, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), "o_custkey", F.lit("X").alias("o_orderstatus"), "o_totalprice")
    con.insert("orders", more)
    return con.scan("orders")


@query("dml_delete", f"SELECT o_orderkey, rowid FROM ({_IDS}) WHERE NOT (o_custkey % 7 = 0)")
def _(spark, d):
    con = _orders(spark, d)
    con.delete("orders", con.scan("orders", rowid=True).where("o_custkey % 7 = 0").select("rowid"))
    return con.scan("orders", rowid=True).select("o_orderkey", "rowid")


@query("dml_update", f"SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, rowid FROM ({_IDS})")
def _(spark, d):
    con = _orders(spark, d)
    con.update("orders", con.scan("orders", rowid=True).where("o_custkey % 5 = 0").select("rowid", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderstatus")))
    return con.scan("orders", rowid=True).select("o_orderkey", "o_totalprice", "o_orderstatus", "rowid")


@query("dml_checkpoint", f"SELECT o_orderkey, rowid FROM ({_IDS}) WHERE o_orderstatus <> 'F'")
def _(spark, d):
    con = _orders(spark, d)
    con.delete("orders", con.scan("orders", rowid=True).where("o_orderstatus = 'F'").select("rowid"))
    con.checkpoint("orders")
    return con.db.connect().scan("orders", rowid=True).select("o_orderkey", "rowid")


@query("snapshot_visible", "SELECT 'snapshot' AS reader, count(*) AS n FROM orders UNION ALL SELECT 'after', count(*) FILTER (o_custkey % 2 <> 0) FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    reader = con.db.connect()
    reader.begin()
    con.delete("orders", con.scan("orders", rowid=True).where("o_custkey % 2 = 0").select("rowid"))
    con.rollback()
    count = lambda c, who: c.scan("orders").agg(F.lit(who).alias("reader"), F.count("*").alias("n")).select("reader", "n")
    return count(reader, "snapshot").unionByName(count(con, "after"))


@query("txn_rollback", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    con.begin()
    con.delete("orders", con.scan("orders", rowid=True).where("o_custkey % 2 = 0").select("rowid"))
    con.rollback()
    return con.scan("orders").agg(F.count("*").alias("n"))


@query("alter_add_col", "SELECT o_orderkey, 7 AS extra FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    con.add_column("orders", "extra", "INTEGER", default=7)
    return con.scan("orders").select("o_orderkey", "extra")


@query("alter_drop_col", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    con.drop_column("orders", "o_orderstatus")
    return con.scan("orders")


@query("alter_rename_col", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    con.rename_column("orders", "o_totalprice", "price")
    return con.scan("orders").select("o_orderkey", "price")


@query("alter_cast", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    con.alter_type("orders", "o_custkey", "VARCHAR")
    return con.scan("orders").select("o_orderkey", "o_custkey")


@query("copy_csv", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    con = _orders(spark, d)
    path = f"{con.db.root}/export"
    con.copy_to("orders", path, "csv", ScanRequest(["o_orderkey", "o_totalprice"]).push_filter("o_orderstatus", Compare("=", "O")))
    con.create_table("back", [("o_orderkey", "BIGINT"), ("o_totalprice", "DOUBLE")])
    con.copy_from("back", path, "csv")
    return con.scan("back")


@query("view_scan", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, d):
    con = _orders(spark, d)
    con.create_view("per_customer", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    return con.view("per_customer")


@query("seq_values", "SELECT s_suppkey, 13 + 5 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS id FROM supplier")
def _(spark, d):
    """Rows numbered by a sequence: a block as long as the table is reserved, and row ids choose within it."""
    con = scratch_database(spark).connect()
    con.create_sequence("ids", start=8, increment=5)
    con.next_value("ids")
    con.create_table("s", [("s_suppkey", "BIGINT")])
    con.insert("s", table(spark, d, "supplier").select("s_suppkey").orderBy("s_suppkey"))
    block = con.next_values("ids", con.scan("s").count())
    return con.scan("s", rowid=True).select("s_suppkey", (block.start + block.step * F.col("rowid")).alias("id"))


@query("scan_sample", "SELECT 'rows of the table' AS fact, true AS holds UNION ALL SELECT 'about the share', true UNION ALL SELECT 'again the same', true")
def _(spark, d):
    """A sampled scan: rows of the table, about the share asked for, the same ones for the same seed."""
    take = lambda: ScanRequest(["l_orderkey", "l_quantity"]).sample(0.3, 7).apply(table(spark, d, "lineitem"))
    n = table(spark, d, "lineitem").count()
    holds = lambda c: F.coalesce(c, F.lit(True)).alias("holds")
    known = table(spark, d, "lineitem").select("l_orderkey", "l_quantity").distinct()
    stray = take().join(known, ["l_orderkey", "l_quantity"], "left_anti").agg(holds(F.count("*") == 0))
    share = take().agg(holds(F.count("*").between(int(0.25 * n), int(0.35 * n))))
    both = take().withColumn("sign", F.lit(1)).unionByName(take().withColumn("sign", F.lit(-1)))
    again = both.agg(holds(F.sum(F.col("sign") * F.xxhash64("l_orderkey", "l_quantity").cast("decimal(30,0)")) == 0))
    parts = [f.select(F.lit(name).alias("fact"), "holds") for name, f in (("rows of the table", stray), ("about the share", share), ("again the same", again))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("catalog_entries", "SELECT 'main' AS schema, 'orders' AS name, 'o_orderkey' AS first_column, 'BIGINT' AS type UNION ALL SELECT 'side', 'notes', 'id', 'INTEGER'")
def _(spark, d):
    """Schemas and tables made, listed, and dropped again."""
    con = _orders(spark, d)
    con.create_schema("side")
    con.create_table("side.notes", [("id", "INTEGER"), ("text", "VARCHAR")])
    con.create_table("side.gone", [("id", "INTEGER")])
    con.drop_table("side.gone")
    con.create_schema("empty")
    con.drop_schema("empty")
    rows = [(s, t, *columns[0]) for s in ("main", "side") for t, columns in con.get_schema(s).items()]
    return spark.createDataFrame(rows, "schema string, name string, first_column string, type string")


@query("txn_conflict", "SELECT 'second' AS loser, count(*) FILTER (o_custkey % 2 <> 0) AS n FROM orders")
def _(spark, d):
    """Two transactions delete the same rows: the first to commit wins."""
    con = _orders(spark, d)
    other = con.db.connect()
    con.begin()
    other.begin()
    for c in (con, other):
        c.delete("orders", c.scan("orders", rowid=True).where("o_custkey % 2 = 0").select("rowid"))
    con.commit()
    try:
        other.commit()
        loser = "none"
    except ConflictError:
        loser = "second"
    return con.scan("orders").agg(F.lit(loser).alias("loser"), F.count("*").alias("n"))


@query("table_files", "SELECT 'insert' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'delete', count(*) FILTER (o_orderstatus = 'F') FROM orders")
def _(spark, d):
    con = _orders(spark, d)
    con.delete("orders", con.scan("orders", rowid=True).where("o_orderstatus = 'F'").select("rowid"))
    return spark.createDataFrame([(f["kind"], f["rows"]) for f in con.files("orders")], "kind string, n long")


_STUDENTS = "SELECT i::INT AS id, (18 + i % 10)::INT AS age, (50 + i % 50)::INT AS score FROM range(1, 10001) t(i)"


@query("students_scan", f"SELECT age, count(*) AS n, min(score) AS low, max(score) AS high FROM ({_STUDENTS}) WHERE id > 100 GROUP BY age")
def _(spark, d):
    """Bulk insert of integers, then a filtered scan."""
    con = scratch_database(spark).connect()
    con.create_table("students", [("id", "INTEGER"), ("age", "INTEGER"), ("score", "INTEGER")])
    i = F.col("id")
    con.insert("students", spark.range(1, 10_001).select(i.cast("int").alias("id"), (18 + i % 10).cast("int").alias("age"), (50 + i % 50).cast("int").alias("score")))
    rows = con.scan("students", ScanRequest(["age", "score"]).push_filter("id", Compare(">", 100)))
    return rows.groupBy("age").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(
    "students_nested",
    "SELECT i AS id, array_to_string(list_transform(range(i % 3 + 1), lambda j: 1000 + (i + j) % 200), '|') AS courses, (i % 3 + 1) AS n, (70 + i % 25)::INT AS second, (18 + i % 10)::INT AS age FROM range(1, 2001) t(i)",
)
def _(spark, d):
    """Lists, fixed arrays and structs through storage and a checkpoint."""
    con = scratch_database(spark).connect()
    con.create_table("s", [("id", "INTEGER"), ("course_ids", "LIST(INTEGER)"), ("scores", "ARRAY(INTEGER,3)"), ("profile", "STRUCT(age INTEGER, level INTEGER)")])
    i = F.col("id")
    courses = F.transform(F.sequence(F.lit(0).cast("long"), i % 3), lambda j: 1000 + (i + j) % 200)
    con.insert("s", spark.range(1, 2001).select(i, courses.alias("course_ids"), F.array(60 + i % 40, 70 + i % 25, 80 + i % 15).alias("scores"), F.struct((18 + i % 10).alias("age"), (1 + i % 4).alias("level")).alias("profile")))
    con.checkpoint("s")
    s = con.db.connect().scan("s")
    return s.select(F.col("id").cast("long").alias("id"), fn.array_to_string(F.col("course_ids"), "|").alias("courses"), fn.list_count(F.col("course_ids")).alias("n"), fn.element(F.col("scores"), 2).alias("second"), fn.struct_extract(F.col("profile"), "age").alias("age"))


# ---- statistics ------------------------------------------------------------------------------------


@query("agg_count", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query("agg_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("approx_distinct", "SELECT true AS parts, true AS orders")
def _(spark, d):
    """Whether the estimates lie within 10 % of the exact counts."""
    near = lambda c: (F.abs(F.approx_count_distinct(c) - F.count_distinct(c)) <= 0.1 * F.count_distinct(c))
    return table(spark, d, "lineitem").agg(near("l_partkey").alias("parts"), near("l_orderkey").alias("orders"))


@query("stats_minmax", "SELECT min(l_orderkey) AS min_value, max(l_orderkey) AS max_value, count(*) AS row_count FROM lineitem")
def _(spark, d):
    return stats.column_stats(table(spark, d, "lineitem"), "l_orderkey").select("min_value", "max_value", "row_count")


@query("stats_string", "SELECT min(c_name[1:8]) AS min_prefix, max(c_name[1:8]) AS max_prefix, max(strlen(c_name)) AS max_bytes, max(length(c_name) <> strlen(c_name)) AS has_unicode FROM customer")
def _(spark, d):
    return stats.column_stats(table(spark, d, "customer"), "c_name").select("min_prefix", "max_prefix", "max_bytes", "has_unicode")


@query("stats_nulls", f"SELECT max(status IS NULL) AS has_null, max(status IS NOT NULL) AS has_no_null FROM ({_NULLED})")
def _(spark, d):
    return stats.column_stats(_nulled(spark, d), "status").select("has_null", "has_no_null")


@query("stats_constant", "SELECT r_regionkey, true AS is_constant FROM region")
def _(spark, d):
    return stats.column_stats(table(spark, d, "region"), "r_name", ["r_regionkey"]).select("r_regionkey", "is_constant")


@query("stats_struct_child", "SELECT min(o_custkey) AS min_value, max(o_custkey) AS max_value, false AS has_null FROM orders")
def _(spark, d):
    s = table(spark, d, "orders").select(F.struct("o_custkey").alias("s"))
    return stats.column_stats(s, "s.o_custkey").select("min_value", "max_value", "has_null")


@query("stats_list_child", "SELECT min(x) AS min_value, max(x) AS max_value FROM (SELECT unnest([l_linenumber, l_linenumber + 10]) AS x FROM lineitem)")
def _(spark, d):
    e = table(spark, d, "lineitem").select(F.explode(F.array("l_linenumber", F.col("l_linenumber") + 10)).alias("x"))
    return stats.column_stats(e, "x").select("min_value", "max_value")


_STATS_COLUMNS = ["s_suppkey", "s_name", "s_nationkey"]


@query("stats_table", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS value_count, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM supplier" for c in _STATS_COLUMNS))
def _(spark, d):
    return stats.table_stats(table(spark, d, "supplier"), _STATS_COLUMNS)


@query("stats_stored", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS value_count, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, true AS distinct_near FROM supplier" for c in _STATS_COLUMNS))
def _(spark, d):
    """Statistics that the insert stored, without a look at the rows; the estimates lie within 15 % of the exact counts."""
    con = scratch_database(spark, zone_bits=6).connect()
    con.create_table("s", [("s_suppkey", "BIGINT"), ("s_name", "VARCHAR"), ("s_nationkey", "BIGINT")])
    con.insert("s", table(spark, d, "supplier").select(*_STATS_COLUMNS))
    exact = con.scan("s").agg(*[F.count_distinct(c).alias(c) for c in _STATS_COLUMNS]).first()
    wanted = F.create_map(*[F.lit(x) for c in _STATS_COLUMNS for x in (c, exact[c])])[F.col("column_name")]
    near = F.abs(F.col("approx_distinct") - wanted) <= 0.15 * wanted
    return con.statistics("s").withColumn("distinct_near", near).drop("approx_distinct")


_SMALL_GROUP = 2048


@query("row_group_counts", f"SELECT rowid // {_SMALL_GROUP} AS rg, count(*) AS row_count, min(o_orderkey) AS low, max(o_orderkey) AS high FROM ({_IDS}) GROUP BY rg")
def _(spark, d):
    zones = stats.zone_map(_orders(spark, d).scan("orders", rowid=True), ["o_orderkey"], "rowid", _SMALL_GROUP)
    return zones.select("rg", "row_count", F.col("o_orderkey.low").alias("low"), F.col("o_orderkey.high").alias("high"))


_PRUNED = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 3000 AND 5000 AND o_orderstatus = 'O'"
#: Zones of 2 ** 11 rows, so that small tables have several.
_SMALL_ZONES = 11


@query("scan_pruned", _PRUNED)
def _(spark, d):
    """Zones are chosen by the statistics that the insert stored; only those are read."""
    wanted = ScanRequest(["o_orderkey", "o_orderstatus"]).push_filter("o_orderkey", Compare(">=", 3000)).push_filter("o_orderkey", Compare("<=", 5000)).push_filter("o_orderstatus", Compare("=", "O"))
    return _orders(spark, d, zone_bits=_SMALL_ZONES).scan("orders", wanted, pruned=True)


@query("scan_pruned_on_demand", _PRUNED)
def _(spark, d):
    """The same by a zone map computed on the spot, for tables without stored statistics."""
    rows = _orders(spark, d).scan("orders", rowid=True)
    filters = FilterSet().push("o_orderkey", Compare(">=", 3000)).push("o_orderkey", Compare("<=", 5000)).push("o_orderstatus", Compare("=", "O"))
    zones = stats.zone_map(rows, ["o_orderkey", "o_orderstatus"], "rowid", _SMALL_GROUP)
    return stats.pruned_scan(rows, zones, filters, "rowid", _SMALL_GROUP).select("o_orderkey", "o_orderstatus")


@query("topk_by_statistics", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50 OFFSET 20")
def _(spark, d):
    """The order's first rows from the zones that can hold any of them."""
    return _orders(spark, d, zone_bits=_SMALL_ZONES).top("orders", "o_orderkey", 50, 20, descending=True).select("o_orderkey", "o_totalprice")


@query("auto_checkpoint", f"SELECT o_orderkey, rowid, 1 AS entries FROM ({_IDS}) WHERE o_orderstatus = 'F'")
def _(spark, d):
    """A delete of most of the table makes the commit checkpoint it."""
    con = _orders(spark, d, checkpoint_after=1)
    con.delete("orders", con.scan("orders", rowid=True).where("o_orderstatus <> 'F'").select("rowid"))
    entries = len(con.files("orders"))
    return con.scan("orders", rowid=True).select("o_orderkey", "rowid", F.lit(entries).alias("entries"))


@query("stats_merge", "SELECT count(*) AS row_count, min(o_orderkey) AS min_value, max(o_orderkey) AS max_value FROM orders")
def _(spark, d):
    groups = stats.column_stats(table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"])
    return stats.merge_stats(groups).select("row_count", "min_value", "max_value")


# ---- chunks ----------------------------------------------------------------------------------------


@query("chunk_reference", "SELECT n_regionkey, n_name FROM nation")
def _(spark, d):
    return chunks.reference_columns(table(spark, d, "nation"), [2, 1])


@query("chunk_slice", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
def _(spark, d):
    return chunks.slice_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 30, 20)


@query("chunk_append", "SELECT * FROM region UNION ALL SELECT * FROM region WHERE r_regionkey > 2")
def _(spark, d):
    r = table(spark, d, "region")
    return chunks.append(r, r.where("r_regionkey > 2"))


@query("chunk_split_fuse", "SELECT * FROM nation")
def _(spark, d):
    left, right = chunks.split_columns(table(spark, d, "nation").withColumn("k", F.col("n_nationkey")).select("k", "n_nationkey", "n_name", "n_regionkey"), 3)
    right = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), *right.columns)
    return chunks.fuse(left, right, ["k"]).drop("k")


@query("chunk_sequence", "SELECT 5 + 3 * i AS value FROM range(1000) t(i)")
def _(spark, d):
    return chunks.sequence(spark, 5, 1000, 3)


@query("chunk_constant", "SELECT r_name, 42 AS c FROM region")
def _(spark, d):
    return chunks.constant(table(spark, d, "region").select("r_name"), "c", 42)


for _kind, _word in (("all", "UNION ALL"), ("distinct", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    QUERIES[f"set_{_kind}"] = lambda spark, d, k=_kind: chunks.union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_nationkey").alias("k")), k)
    ORACLE_SQL[f"set_{_kind}"] = f"SELECT c_nationkey AS k FROM customer {_word} SELECT s_nationkey FROM supplier WHERE s_nationkey < 12"


# ---- delegated SQL -----------------------------------------------------------------------------------


@query("agg_student_style", "SELECT count(*) AS n, avg(l_quantity) AS avg_qty, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("avg_qty"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))


def _top(name: str, order: list[str], ascending: list[bool], limit: int = 10, offset: int = 0) -> None:
    sql_order = ", ".join(c if up else f"{c} DESC" for c, up in zip(order, ascending))
    QUERIES[name] = lambda spark, d: table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(*order, ascending=ascending).offset(offset).limit(limit)
    ORACLE_SQL[name] = f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_order} LIMIT {limit} OFFSET {offset}"


_top("topk_asc", ["o_totalprice", "o_orderkey"], [True, True])
_top("topk_desc", ["o_totalprice", "o_orderkey"], [False, True])
_top("topk_offset", ["o_totalprice", "o_orderkey"], [False, True], 10, 25)
_top("order_limit", ["o_orderkey"], [True])


@query("fn_concat", "SELECT r_regionkey, concat(r_name, '') AS s FROM region")
def _(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.concat("r_name", F.lit("")).alias("s"))


@query("fn_date_between", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1970-01-01' + 9500 AND DATE '1970-01-01' + 9600")
def _(spark, d):
    day = F.col("l_shipdate").cast("date")
    return table(spark, d, "lineitem").where(day.between(fn.day(F.lit(9500)), fn.day(F.lit(9600)))).select("l_orderkey", "l_linenumber", day.alias("day"))


@query("fn_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "middle").otherwise("low").alias("band"))


_LIST = "SELECT n_nationkey, [n_nationkey, n_regionkey, NULLIF(n_nationkey % 3, 0)] AS l FROM nation"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.array("n_nationkey", "n_regionkey", F.nullif(F.col("n_nationkey") % 3, F.lit(0))).alias("l"))


@query("fn_list", f"SELECT n_nationkey, array_to_string(l, '|') AS joined, list_count(l) AS n FROM ({_LIST})")
def _(spark, d):
    return _lists(spark, d).select("n_nationkey", fn.array_to_string(F.col("l"), "|").alias("joined"), fn.list_count(F.col("l")).alias("n"))


@query("fn_array_index", f"SELECT n_nationkey, l[1] AS a, l[3] AS c, l[9] AS none FROM ({_LIST})")
def _(spark, d):
    return _lists(spark, d).select("n_nationkey", fn.element(F.col("l"), 1).alias("a"), fn.element(F.col("l"), 3).alias("c"), fn.element(F.col("l"), 9).alias("none"))


@query("fn_struct_extract", "SELECT o_orderkey, struct_extract({'c': o_custkey, 'p': o_totalprice}, 'p') AS p FROM orders")
def _(spark, d):
    s = F.struct(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    return table(spark, d, "orders").select("o_orderkey", fn.struct_extract(s, "p").alias("p"))


# ---- joins, windows, grouping sets, events: extensions ---------------------------------------------------


def _join(name: str, how: str, select: str, columns: str) -> None:
    """Customers of two segments with the orders above a price."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name")
        o = table(spark, d, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_custkey")
        return c.join(o, F.col("c_custkey") == F.col("o_custkey"), how).select(*columns.split(", "))

    QUERIES[name], ORACLE_SQL[name] = run, select


_C, _O = "(SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING') c", "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000) o"
_join("join_inner", "inner", f"SELECT c_custkey, o_orderkey FROM {_C} JOIN {_O} ON c_custkey = o_custkey", "c_custkey, o_orderkey")
_join("join_left", "left", f"SELECT c_custkey, o_orderkey FROM {_C} LEFT JOIN {_O} ON c_custkey = o_custkey", "c_custkey, o_orderkey")
_join("join_semi", "left_semi", f"SELECT c_custkey, c_name FROM {_C} WHERE c_custkey IN (SELECT o_custkey FROM {_O})", "c_custkey, c_name")
_join("join_anti", "left_anti", f"SELECT c_custkey, c_name FROM {_C} WHERE c_custkey NOT IN (SELECT o_custkey FROM {_O})", "c_custkey, c_name")


@query("join_asof", "SELECT e.event_id, p.value AS value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "value").select("event_id", "value")


@query("join_range", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 20")
def _(spark, d):
    ranges = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return joins.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 20.0).select("p_partkey", "s_suppkey")


@query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def _(spark, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", place.cast("long").alias("place")).where("place <= 3")


@query("events_windowed", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return streams.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("events_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(spark, d):
    return streams.sessions(table(spark, d, "events"))
