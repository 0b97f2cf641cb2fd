"""Types, filters, statistics and transactions."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowstrata.operators import stats
from rowstrata.plans.filters import And, Compare, Field, FilterSet, In, IsNotNull, IsNull, Or, Prefix, Verdict, ZoneStats, literal
from rowstrata.plans.scan import ScanRequest
from rowstrata.sources.database import ConflictError, DatabaseError
from rowstrata.sources.scratch import scratch_database
from rowstrata.types import parse_type, show_value


# ---- types


def test_type_names_round_trip():
    for t in ["INTEGER", "DECIMAL(10,2)", "LIST(INTEGER)", "ARRAY(INTEGER,3)", "STRUCT(a INTEGER, b LIST(VARCHAR))", "MAP(VARCHAR, BIGINT)", "LIST(STRUCT(id INTEGER, score DECIMAL(4,1)))"]:
        assert str(parse_type(t)) == t
    for t in ["DECIMAL(3,5)", "NOTHING", "INTEGER(4)", "DECIMAL(39,0)", ""]:
        with pytest.raises(ValueError):
            parse_type(t)
    assert show_value([1, None, {"k": b"ab"}, True]) == "[1, NULL, {k: <blob:2 bytes>}, true]"


NESTED = [
    ("LIST(INTEGER)", [[10, 11], None, [], [30, 31, None]]), ("ARRAY(INTEGER,3)", [[1, 2, 3], None, [7, 8, 9]]), ("STRUCT(id INTEGER, score INTEGER)", [(1, 90), None, (None, None)]),
    ("LIST(STRUCT(id INTEGER, score INTEGER))", [[(1, 10), (2, 20)], [], [(3, 30)]]), ("STRUCT(items LIST(INTEGER), fixed ARRAY(INTEGER,2))", [([1, 2], [10, 11]), ([], [20, 21])]),
    ("LIST(LIST(INTEGER))", [[[1, 2], []], [], [[3], [4, 5]]]), ("STRUCT(person STRUCT(id INTEGER, score INTEGER), level INTEGER)", [((1, 10), 100), ((2, 20), 200)]),
]


@pytest.mark.parametrize("kind, values", NESTED, ids=[k for k, _ in NESTED])
def test_nested_values_survive_storage(spark, kind, values):
    con = scratch_database(spark).connect()
    con.create_table("t", [("v", kind)])
    con.insert("t", [(v,) for v in values])
    plain = lambda v: tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v
    want = [plain(v) for v in values]
    read = lambda c: [plain(r["v"]) for r in c.scan("t", rowid=True).orderBy("rowid").collect()]
    assert read(con) == want
    con.checkpoint("t")
    assert read(con.db.connect()) == want


def test_values_out_of_their_type_are_refused(spark):
    con = scratch_database(spark).connect()
    con.create_table("t", [("u", "UTINYINT"), ("a", "ARRAY(INTEGER,2)")])
    con.insert("t", [(255, [1, 2]), (None, None)])
    for bad in ((256, [1, 2]), (-1, [1, 2]), (1, [1])):
        with pytest.raises(Exception, match="is no"):
            con.insert("t", [bad])
    assert con.scan("t").count() == 2


def test_students(spark):
    con = scratch_database(spark).connect()
    con.create_table("students", [("id", "INTEGER"), ("name", "VARCHAR"), ("gpa", "FLOAT"), ("age", "INTEGER"), ("is_active", "BOOLEAN"), ("enrollment_day", "DATE")])
    first = datetime.date(1970, 1, 1)
    names = "Alice Bob Charlie Diana Eve Frank Grace Henry Iris Jack".split()
    con.insert("students", [(i + 1, names[i % 10], 2.0 + (i % 20) * 0.1, 18 + i % 10, i % 3 != 0, first + datetime.timedelta(10957 + 30 * i)) for i in range(100)])
    r = con.scan("students").agg(F.count("*"), F.avg("age"), F.sum(F.col("is_active").cast("int"))).first()
    assert tuple(r) == (100, 22.5, 66)
    day = con.scan("students", ScanRequest(["id"]).push_filter("enrollment_day", And((Compare(">=", first + datetime.timedelta(10957)), Compare("<=", first + datetime.timedelta(11500))))))
    assert day.count() == 19


# ---- filters


def test_bad_filters_are_refused():
    for bad in (lambda: Compare("=", None), lambda: Compare("~", 1), lambda: In([]), lambda: In([1, None]), lambda: In([1, "a"])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    "stats_, f, want",
    [
        (ZoneStats(10, 20, False), Compare("=", 30), Verdict.NEVER), (ZoneStats("apple", "banana", False), Compare("=", "carrot"), Verdict.NEVER), (ZoneStats(10, 20, False), In([1, 2, 3]), Verdict.NEVER),
        (ZoneStats(10, 20, False), And((Compare(">", 5), Compare("<", 15))), Verdict.MAYBE), (ZoneStats(None, None, True, False), IsNull(), Verdict.ALWAYS), (ZoneStats(1, 2, False), IsNotNull(), Verdict.ALWAYS),
        (ZoneStats(children={"a": ZoneStats(10, 20, False)}), Field("a", Compare("=", 30)), Verdict.NEVER), (ZoneStats(5, 5, True), In([5]), Verdict.MAYBE), (ZoneStats(5, 5, False), In([5]), Verdict.ALWAYS),
        (ZoneStats("b", "d", False), Compare(">", "d"), Verdict.NEVER), (ZoneStats("b", "d", False), Compare(">=", "d"), Verdict.MAYBE), (ZoneStats(2**53, 2**53 + 1, False), Compare("=", 2**53 + 2), Verdict.NEVER),
        (ZoneStats(1.0, float("nan"), False), Compare(">", 9e99), Verdict.MAYBE), (ZoneStats(None, None, True, False), Compare("!=", 1), Verdict.NEVER), (ZoneStats(1, 9, True), Or((IsNull(), Compare(">=", 0))), Verdict.MAYBE),
    ],
)
def test_verdicts(stats_, f, want):
    assert f.check(stats_) is want


VALUES = {"long": [None, -3, 0, 2, 2, 7, 2**53 + 1], "string": [None, "", "a", "ab", "b", "ü", "a'b"], "double": [None, -1.5, 0.0, float("nan"), 1e300, 2.5], "boolean": [None, True, False]}


def _matches(f, v):
    """What SQL says of a value, in plain Python."""
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, And):
        return all(_matches(p, v) for p in f.parts)
    if isinstance(f, Or):
        return any(_matches(p, v) for p in f.parts)
    if v is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return v in f.values
    if isinstance(f, Prefix):
        return v.startswith(f.text)
    x = (1, 0.0) if v != v else (0, v.encode() if isinstance(v, str) else v)
    y = (0, f.value.encode() if isinstance(f.value, str) else f.value)
    return {"=": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[f.op]


@pytest.mark.parametrize("kind", VALUES)
def test_filters_match_and_prune_soundly(spark, kind):
    """Every filter on every type, scanned and pruned row group by row group."""
    values = VALUES[kind] * 3
    random.Random(1).shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), f"__rowid long, v {kind}")
    constants = [v for v in dict.fromkeys(VALUES[kind]) if v is not None and v == v]
    filters = [Compare(op, c) for op, c in itertools.product(("=", "!=", ">", ">=", "<", "<="), constants)] + [IsNull(), IsNotNull(), In(constants[:2]), And((Compare(">", constants[0]), Compare("<=", constants[-1]))), Or((Compare("=", constants[0]), IsNull()))]
    filters += [Prefix("a"), Prefix("")] * (kind == "string")
    zones = stats.zone_map(df, ["v"], rows=3)
    marks = df.select("__rowid", *[f.column(F.col("v")).alias(f"f{i}") for i, f in enumerate(filters)]).collect()
    for i, f in enumerate(filters):
        want = {k for k, v in enumerate(values) if _matches(f, v)}
        assert {r["__rowid"] for r in marks if r[f"f{i}"]} == want, f
        for rg, verdict in stats.verdicts(zones, FilterSet({"v": f})).items():
            group = set(range(rg * 3, min(rg * 3 + 3, len(values))))
            assert verdict is not Verdict.NEVER or not group & want, f
            assert verdict is not Verdict.ALWAYS or group <= want, f


def test_filter_set_and_sql():
    s = FilterSet().push("a", Compare(">", 1)).push("a", Compare("<", 5)).push("b", In(["x'y"]))
    assert s.get("a") == And((Compare(">", 1), Compare("<", 5))) and len(s) == 2
    assert s.sql() == "(a > 1 AND a < 5) AND b IN ('x''y')"
    t = s.copy()
    t.remove("a")
    assert s != t and len(t) == 1 and literal(b"\x01") == "X'01'" and literal(True) == "TRUE"


def test_scan_pushes_filters_and_prunes_columns(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = ScanRequest(["l_returnflag"]).push_filter("l_orderkey", Compare("=", 1)).apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,1)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    with pytest.raises(KeyError, match="l_orderkey"):
        ScanRequest(["l_orderky"]).apply(df)


# ---- transactions


def _accounts(spark):
    con = scratch_database(spark).connect()
    con.create_table("accounts", [("id", "INTEGER"), ("balance", "INTEGER"), ("active", "BOOLEAN")])
    con.insert("accounts", [(i, 100 * i, True) for i in range(1, 6)])
    return con


def _ids(con):
    return sorted(r["id"] for r in con.scan("accounts").collect())


def test_transaction_scenario(spark):
    con = _accounts(spark)
    con.begin()
    with pytest.raises(DatabaseError, match="already in transaction"):
        con.begin()
    other = con.db.connect()
    other.begin()
    other.rollback()
    con.insert("accounts", [(101, 1, True), (102, 2, True)])
    assert len(_ids(con)) == 7 and len(_ids(con.db.connect())) == 5
    con.rollback()
    con.rollback()
    assert len(_ids(con)) == 5
    changes = spark.createDataFrame([(1, 250, True), (3, 450, False)], "rowid long, balance int, active boolean")
    with con.transaction():
        assert con.update("accounts", changes) == 2
    rows = {r["id"]: r for r in con.scan("accounts").collect()}
    assert rows[2]["balance"] == 250 and not rows[4]["active"] and rows[3]["balance"] == 300
    with con.transaction():
        assert con.delete("accounts", [0, 4]) == 2
        assert con.delete("accounts", [0, 4, 99]) == 0
    assert _ids(con) == [2, 3, 4]
    with pytest.raises(DatabaseError):
        con.update("accounts", changes.limit(1).withColumn("rowid", F.lit(0).cast("long")))
    with pytest.raises(DatabaseError):
        con.commit()
    con.checkpoint("accounts")
    con.db.vacuum()
    again = type(con.db)(spark, con.db.root).connect()
    assert [(r["id"], r["rowid"]) for r in again.scan("accounts", rowid=True).orderBy("rowid").collect()] == [(2, 1), (3, 2), (4, 3)]


def test_snapshots_and_conflicts(spark):
    con = _accounts(spark)
    reader, writer = con.db.connect(), con.db.connect()
    reader.begin()
    writer.begin()
    con.delete("accounts", [1])
    con.insert("accounts", [(6, 600, True)])
    assert _ids(reader) == [1, 2, 3, 4, 5] and _ids(con) == [1, 3, 4, 5, 6]
    writer.insert("accounts", [(7, 700, True)])
    writer.delete("accounts", [2])
    writer.commit()
    assert _ids(con) == [1, 4, 5, 6, 7]
    assert sorted(r["rowid"] for r in con.scan("accounts", rowid=True).collect()) == [0, 3, 4, 5, 6]
    late = con.db.connect()
    late.begin()
    con.delete("accounts", [0])
    late.delete("accounts", [0, 3])
    with pytest.raises(ConflictError):
        late.commit()
    assert _ids(con) == [4, 5, 6, 7]


def test_own_rows_can_be_changed_before_commit(spark):
    con = _accounts(spark)
    with con.transaction():
        con.insert("accounts", [(9, 900, True)])
        assert con.delete("accounts", [5]) == 1
        con.insert("accounts", [(10, 1000, True)])
        con.update("accounts", spark.createDataFrame([(6, 1)], "rowid long, balance int"))
    assert [(r["id"], r["balance"]) for r in con.fetch("accounts", [5, 6]).collect()] == [(10, 1)]


def test_broken_manifest_is_passed_over(spark):
    con = _accounts(spark)
    version = con.db.latest()["version"]
    con.db.store.create(f"_log/{version + 1:08d}.json", '{"version": ')
    assert _ids(con.db.connect()) == [1, 2, 3, 4, 5]
    con.insert("accounts", [(6, 600, True)])
    assert _ids(con.db.connect()) == [1, 2, 3, 4, 5, 6]


def test_concurrent_writers(spark):
    """Four workers insert at once; the last rolls back."""
    from concurrent.futures import ThreadPoolExecutor

    con = scratch_database(spark).connect()
    con.create_table("w", [("worker_id", "INTEGER"), ("seq", "INTEGER")])

    def work(worker):
        own = con.db.connect()
        own.begin()
        for part in range(5):
            own.insert("w", [(worker, part * 5 + k) for k in range(5)])
        own.rollback() if worker == 3 else own.commit()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    rows = con.scan("w", rowid=True).collect()
    assert sorted((r["worker_id"], r["seq"]) for r in rows) == [(w, s) for w in range(3) for s in range(25)]
    assert sorted(r["rowid"] for r in rows) == list(range(75))


def test_catalog(spark):
    con = scratch_database(spark).connect()
    con.create_schema("sales")
    con.create_table("sales.t", [("a", "INTEGER")])
    con.create_table("t", [("a", "TINYINT"), ("b", "HUGEINT")])
    assert con.tables() == ["t", "t"] and con.get_schema("sales") == {"t": [("a", "INTEGER")]}
    assert con.get_schema() == {"t": [("a", "TINYINT"), ("b", "HUGEINT")]}
    for bad in (lambda: con.create_schema("sales"), lambda: con.create_table("T", [("x", "INTEGER")]), lambda: con.create_table("a.b.c", [("x", "INTEGER")]), lambda: con.create_table("", [("x", "INTEGER")]), lambda: con.drop_schema("main"), lambda: con.drop_schema("sales"), lambda: con.scan("none"), lambda: con.create_table("nowhere.t", [("x", "INTEGER")])):
        with pytest.raises(DatabaseError):
            bad()
    con.create_table("t", [("x", "INTEGER")], on_conflict="ignore")
    con.create_table("t", [("x", "INTEGER")], on_conflict="replace")
    assert con.get_schema()["t"] == [("x", "INTEGER")]
    con.drop_schema("sales", cascade=True)
    con.begin()
    con.drop_table("t")
    assert con.tables() == [] and con.db.connect().tables() == ["t"]
    con.rollback()
    assert con.tables() == ["t"]


def test_alterations(spark):
    con = _accounts(spark)
    con.add_column("accounts", "note", "VARCHAR", default="old")
    con.insert("accounts", [(6, 600, True, "new")])
    con.drop_column("accounts", "active")
    con.rename_column("accounts", "balance", "amount")
    con.alter_type("accounts", "amount", "VARCHAR")
    con.add_column("accounts", "active", "BOOLEAN")
    con.rename_table("accounts", "books")
    rows = {r["id"]: tuple(r)[1:] for r in con.scan("books").collect()}
    assert rows[1] == ("100", "old", None) and rows[6] == ("600", "new", None)
    assert con.scan("books").columns == ["id", "amount", "note", "active"]


def test_sequences(spark):
    con = scratch_database(spark).connect()
    con.create_sequence("s", start=1, increment=2, most=4)
    assert [con.next_value("s") for _ in range(3)] == [1, 3, None]
    con.create_sequence("c", most=2, cycle=True)
    assert [con.next_value("c") for _ in range(5)] == [1, 2, 1, 2, 1]


def test_statistics_flags(spark):
    df = spark.createDataFrame([(1, "a", [1]), (1, None, None)], "k int, s string, l array<int>")
    r = stats.column_stats(df, "k").first()
    assert (r["is_constant"], r["has_null"], r["has_no_null"]) == (True, False, True)
    r = stats.column_stats(df, "s").first()
    assert (r["is_constant"], r["has_null"], r["has_unicode"], r["max_bytes"]) == (False, True, False, 1)
    assert "approx_distinct" not in stats.column_stats(df, "l").columns
    assert stats.column_stats(df.limit(0), "k").first()["has_null"] is False


def test_defaults_not_null_and_comments(spark):
    con = _accounts(spark)
    con.set_default("accounts", "active", False)
    con.insert("accounts", spark.createDataFrame([(6, 600)], "id int, balance int"))
    assert con.fetch("accounts", [5]).first()["active"] is False
    con.set_not_null("accounts", "balance")
    with pytest.raises(Exception, match="takes no NULL"):
        con.insert("accounts", [(7, None, True)])
    con.set_not_null("accounts", "balance", False)
    con.insert("accounts", [(7, None, True)])
    with pytest.raises(DatabaseError, match="holds NULLs"):
        con.set_not_null("accounts", "balance")
    con.comment("accounts", "books", "id")
    with pytest.raises(DatabaseError):
        con.insert("accounts", spark.createDataFrame([(6,)], "id int"))


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files_in_and_out(spark, tmp_path, kind):
    con = _accounts(spark)
    con.copy_to("accounts", str(tmp_path / "out"), kind)
    con.create_table("again", [("id", "INTEGER"), ("balance", "INTEGER"), ("active", "BOOLEAN")])
    assert con.copy_from("again", str(tmp_path / "out"), kind) == 5
    assert sorted(map(tuple, con.scan("again").collect())) == sorted(map(tuple, con.scan("accounts").collect()))


def test_sampled_scan(spark):
    df = spark.range(10_000)
    n = ScanRequest().push_filter("id", Compare("<", 5000)).sample(0.1, 3).apply(df).count()
    assert 350 < n < 650
    with pytest.raises(ValueError):
        ScanRequest().sample(2)


def test_vacuum_spares_open_work(spark):
    con = scratch_database(spark).connect()
    con.create_table("t", [("a", "INTEGER")])
    con.insert("t", [(1,)])
    reader = con.db.connect()
    reader.begin()
    con.begin()
    con.insert("t", [(2,)])
    con.db.vacuum()
    con.commit()
    assert con.scan("t").count() == 2 and reader.scan("t").count() == 1
    con.begin()
    con.insert("t", [(3,)])
    con.db.vacuum(min_age=0)
    with pytest.raises(DatabaseError, match="staged files are gone"):
        con.commit()
    assert con.scan("t").count() == 2


def test_rename_into_a_missing_schema_changes_nothing(spark):
    con = scratch_database(spark).connect()
    con.create_table("t", [("a", "INTEGER")])
    with con.transaction():
        with pytest.raises(DatabaseError, match="no schema"):
            con.rename_table("t", "nowhere.t")
    assert con.tables() == ["t"]


def test_many_ranges_are_pruned(spark):
    rows = spark.range(40_000).select(F.col("id").alias("rowid"), (F.col("id") / 2 % 2).cast("int").alias("x"))
    zones = stats.zone_map(rows, ["x"], "rowid", 2)
    got = stats.pruned_scan(rows, zones, FilterSet().push("x", Compare("=", 1)), "rowid", 2)
    assert got.count() == 20_000


def test_blocks_of_a_sequence(spark):
    con = scratch_database(spark).connect()
    con.create_sequence("s", start=3, increment=4, most=20)
    assert list(con.next_values("s", 2)) == [3, 7] and con.next_value("s") == 11
    assert list(con.next_values("s", 9)) == [15, 19] and list(con.next_values("s", 1)) == [] and con.next_value("s") is None


def test_interrupt_stops_own_jobs_alone(spark):
    import threading
    import time

    con, other = scratch_database(spark).connect(), scratch_database(spark).connect()
    ended = {}

    def work(name, c):
        try:
            with c.jobs():
                ended[name] = spark.range(0, 60, 1, 2).select(F.sum(F.expr("aggregate(sequence(0, 3000000), 0L, (a, x) -> a + x + id)"))).count()
        except Exception as e:
            ended[name] = e

    threads = [threading.Thread(target=work, args=a) for a in (("mine", con), ("other", other))]
    for t in threads:
        t.start()
    time.sleep(1.5)
    con.interrupt()
    for t in threads:
        t.join()
    assert not isinstance(ended["other"], Exception)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inserts_of_many_partitions_are_numbered_gapless(spark, monkeypatch):
    from rowstrata.sources import database

    monkeypatch.setattr(database, "INLINE_STARTS", 3)  # starts go to a file of their own
    con = scratch_database(spark, zone_bits=4).connect()
    con.create_table("t", [("a", "BIGINT")])
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("a")).where("a % 3 <> 0 AND NOT a BETWEEN 150 AND 420")
    n = con.insert("t", rows)
    assert con.insert("t", rows.where("a < 0")) == 0
    assert con.insert("t", rows) == n
    got = con.scan("t", rowid=True).orderBy("rowid").collect()
    want = [r["a"] for r in rows.collect()]
    assert [r["rowid"] for r in got] == list(range(2 * n)) and [r["a"] for r in got] == 2 * want
    for a, b in ((0, 1), (n - 3, n + 4), (2 * n - 1, 2 * n + 9), (5, 5), (-4, 2)):
        assert sorted(r["rowid"] for r in con.scan_range("t", a, b).collect()) == list(range(max(a, 0), min(b, 2 * n)))
    ids = [-1, 0, 1, n - 1, n, 2 * n - 1, 2 * n, 2**40]
    assert sorted((r["rowid"], r["a"]) for r in con.fetch("t", ids).collect()) == [(i, (2 * want)[i]) for i in ids[1:-2]]
    assert "PushedFilters: [IsNotNull(__position)" in _plan(con.scan_range("t", 10, 20))
    con.delete("t", [0, n])
    con.update("t", spark.createDataFrame([(1, -5)], "rowid long, a long"))
    con.checkpoint("t")
    con.insert("t", rows)
    got = con.scan("t", rowid=True).orderBy("rowid").collect()
    assert [r["rowid"] for r in got] == [i for i in range(3 * n) if i not in (0, n)]
    assert [r["a"] for r in got][:2] == [-5, want[2]] and [r["a"] for r in got][-n:] == want


def test_inserts_of_two_transactions_keep_their_numbers_apart(spark):
    con = scratch_database(spark).connect()
    con.create_table("t", [("a", "BIGINT")])
    others = [con.db.connect() for _ in range(3)]
    for i, c in enumerate(others):
        c.begin()
        c.insert("t", spark.range(i * 100, i * 100 + 10, 1, 3).select(F.col("id").alias("a")))
    for c in others:
        c.commit()
    con.insert("t", spark.range(900, 905, 1, 2).select(F.col("id").alias("a")))
    got = [(r["rowid"], r["a"]) for r in con.scan("t", rowid=True).orderBy("rowid").collect()]
    assert got == list(enumerate([*range(10), *range(100, 110), *range(200, 210), *range(900, 905)]))
    assert [r["a"] for r in con.fetch("t", [12]).collect()] == [102]


KINDS = {"DOUBLE": [1.5, float("nan"), -2.0, None], "VARCHAR": ["a", "é" * 300, "", None], "DATE": ["2020-01-02", None, "1999-12-31", "1999-12-31"], "INTEGER": [None, None, None, None], "DECIMAL(10,2)": ["1.25", "-3", None, "7"], "BOOLEAN": [True, None, False, True], "BIGINT": [2**62, -5, 0, None], "TIMESTAMP": [None, "2020-01-02 03:04:05", "1969-01-01 00:00:00", None]}


@pytest.mark.parametrize("kind", KINDS)
def test_pruned_scans_lose_nothing(spark, kind):
    """Against plain scans, over zones of two rows, with changed rows and a column added later."""
    con = scratch_database(spark, zone_bits=1).connect()
    con.create_table("t", [("k", "BIGINT"), ("v", kind)])
    rows = spark.createDataFrame([(i, None if v is None else str(v).lower() if kind == "BOOLEAN" else str(v)) for i, v in enumerate(KINDS[kind] * 3)], "k long, v string").coalesce(2)
    con.insert("t", rows.withColumn("v", F.col("v").cast(parse_type(kind).spark())))
    con.update("t", con.scan("t", rowid=True).where("k % 5 = 0").select("rowid", (F.col("k") + 100).alias("k")))
    con.delete("t", [2])
    con.add_column("t", "w", "INTEGER", default=4)
    values = [r["v"] for r in con.scan("t").select("v").distinct().collect() if r["v"] is not None]
    filters = [Compare(op, v) for op in ("=", "!=", ">", ">=", "<", "<=") for v in values[:1]] + [IsNull(), IsNotNull()]
    filters += [Or((Compare("=", v), IsNull())) for v in values[:1]] + ([In(values[:2])] if values else []) + [Prefix(p) for p in ("", "a", "é", "b") if kind == "VARCHAR"]
    for f in filters:
        want = sorted(r["k"] for r in con.scan("t", ScanRequest(["k"]).push_filter("v", f)).collect())
        got = con.scan("t", ScanRequest(["k"]).push_filter("V", f).push_filter("w", Compare("=", 4)), pruned=True)
        assert sorted(r["k"] for r in got.collect()) == want, f
    assert con.scan("t", ScanRequest(["k"]).push_filter("w", Compare("=", 5)), pruned=True).count() == 0
    con.alter_type("t", "v", "VARCHAR")
    assert con.scan("t", ScanRequest(["k"]).push_filter("v", IsNotNull()), pruned=True).count() == con.scan("t").where("v IS NOT NULL").count()


def test_pruned_scans_of_many_zones(spark):
    con = scratch_database(spark, zone_bits=1).connect()
    con.create_table("t", [("a", "BIGINT"), ("b", "INTEGER")])
    con.insert("t", spark.range(0, 4000, 1, 1).select(F.col("id").alias("a"), (F.col("id") / 2 % 2).cast("int").alias("b")))
    many = con.scan("t", ScanRequest(["a"]).push_filter("b", Compare("=", 1)), pruned=True)
    assert many.count() == 2000 and "LeftSemi" in _plan(many)
    few = con.scan("t", ScanRequest(["a"]).push_filter("a", Compare(">", 3990)), pruned=True)
    assert few.count() == 9 and "GreaterThanOrEqual(__position,3990)" in _plan(few)


def test_first_rows_by_statistics(spark):
    con = scratch_database(spark, zone_bits=2).connect()
    con.create_table("t", [("a", "DOUBLE"), ("b", "BIGINT")])
    values = [None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i // 3) for i in range(100)]
    con.insert("t", spark.createDataFrame(list(zip(values, range(100), strict=True)), "a double, b long").coalesce(1))
    rank = lambda i, sign: (values[i] is None, sign * (1e9 if values[i] is not None and values[i] != values[i] else values[i] or 0), i)

    def agrees(gone=()):
        for sign in (1, -1):
            want = sorted(set(range(100)) - set(gone), key=lambda i: rank(i, sign))
            for limit, offset in ((5, 0), (7, 20), (10, 85), (0, 3), (200, 0)):
                assert [r["b"] for r in con.top("t", "A", limit, offset, sign < 0).collect()] == want[offset : offset + limit]

    agrees()
    assert "GreaterThanOrEqual(__position,0)" in _plan(con.top("t", "b", 5))
    con.delete("t", [3, 99])
    agrees([3, 99])


def test_stored_statistics(spark):
    con = scratch_database(spark, zone_bits=1).connect()
    con.create_table("t", [("a", "BIGINT"), ("s", "VARCHAR"), ("l", "LIST(INTEGER)")])
    assert con.statistics("t").count() == 0
    con.insert("t", [(1, "x" * 300, [1]), (None, "y", None), (3, None, []), (3, "z", [2])])
    got = {r["column_name"]: tuple(r)[1:] for r in con.statistics("t").collect()}
    assert got == {"a": (4, 3, "1", "3", 2), "s": (4, 3, None, None, 3)}  # a long text is no bound
    con.delete("t", [0, 1])
    con.checkpoint("t")
    assert {r["column_name"]: tuple(r)[1:] for r in con.statistics("t").collect()} == {"a": (2, 2, "3", "3", 1), "s": (2, 1, "z", "z", 1)}


def test_checkpoints_come_by_themselves_and_conflict_with_changes(spark):
    con = scratch_database(spark, checkpoint_after=3).connect()
    con.create_table("t", [("a", "INTEGER")])
    other = con.db.connect()
    con.insert("t", [(i,) for i in range(8)])
    con.insert("t", [(8,)])
    con.insert("t", [(9,)])
    other.begin()
    other.update("t", spark.createDataFrame([(0, 50)], "rowid long, a int"))
    con.delete("t", [0])
    assert len(con.files("t")) == 4  # few changes beside eight rows
    con.delete("t", [1])
    assert [f["kind"] for f in con.files("t")] == ["compact"]
    with pytest.raises(ConflictError, match="checkpointed"):
        other.commit()
    assert sorted(r["a"] for r in con.scan("t").collect()) == list(range(2, 10))


def test_views_sequences_and_autocommit(spark):
    con = _accounts(spark)
    con.create_view("rich", "SELECT id FROM accounts WHERE balance > 300")
    with pytest.raises(DatabaseError, match="exists"):
        con.create_view("rich", "SELECT 1")
    con.rename_view("rich", "richer")
    con.create_sequence("s")
    con.drop_sequence("s")
    assert list(con.views()) == ["richer"] and con.view("richer").count() == 2
    con.drop_view("richer")
    for missing in (lambda: con.view("richer"), lambda: con.drop_view("richer"), lambda: con.drop_sequence("s")):
        with pytest.raises(DatabaseError, match="no (view|sequence)"):
            missing()
    con.autocommit = False
    con.insert("accounts", [(9, 1, True)])
    assert con.in_transaction and 9 in _ids(con) and 9 not in _ids(con.db.connect())
    con.rollback()
    assert 9 not in _ids(con)


def test_copies_and_shown_rows(spark):
    from rowstrata.operators import chunks
    from rowstrata.types import show_rows

    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(5)], "at long, v string")
    assert sorted(r["v"] for r in chunks.copy_rows(df, "at", 3).collect()) == ["d", "e"]
    chosen = spark.createDataFrame([(0, 4), (1, 2), (2, 2), (3, 9)], "slot long, pick long")
    assert sorted(r["v"] for r in chunks.copy_rows(df, "at", 1, chosen).collect()) == ["c", "c"]
    text = show_rows(["id", "name"], [(i, None if i else "x" * 50) for i in range(20)]).splitlines()
    assert text[3] == "|   0 | " + "x" * 37 + "... |" and len(text) == 18 and text[-2:] == ["... 8 rows left out ...", "(20 rows)"]
    assert show_rows(["a"], []).splitlines()[-1] == "(0 rows)"


@pytest.mark.parametrize("stretches", [1, 2, 64])
def test_asof_join_of_a_hot_key(spark, stretches):
    from rowstrata.operators.joins import asof_join

    rng = random.Random(5)
    some = lambda n: [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.7 else rng.choice("abc"), None if rng.random() < 0.05 else rng.randrange(60)) for i in range(n)]
    left = some(300)
    right = [(k, t, None if rng.random() < 0.1 else i) for i, k, t in some(120)]
    got = asof_join(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), "k", "t", "v", stretches)
    assert sorted(got.columns) == ["id", "k", "t", "v"]

    def want(k, t):
        found = [(rt, rv) for rk, rt, rv in right if rk == k is not None and t is not None and rt is not None and rt <= t and rv is not None]
        return max(found)[1] if found else None

    assert {r["id"]: r["v"] for r in got.collect()} == {i: want(k, t) for i, k, t in left} and got.count() == 300
