"""Every query against its SQL twin."""

from __future__ import annotations

import math

import pytest

from rowstrata import catalogue
from rowstrata.streaming import events as streams

TABLES = "region nation customer supplier part orders lineitem events".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(_plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(_plain, r)) for r in want.fetchall())


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.windowed(streams.read_stream(spark, str(tmp_path / "in"), batch), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(map(_plain, r)) for r in streams.windowed(batch).collect()}
    assert {tuple(map(_plain, r)) for r in spark.sql("SELECT * FROM windowed").collect()} == want
