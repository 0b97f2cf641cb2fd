"""Near copies against all pairs, and in the pipeline's stage."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowstrata.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _kept(texts):
    """The smallest row number of each component, by all pairs."""
    sets, group = [_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return [i for i, g in enumerate(group) if g == i]


def _damaged(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_stage_drops_near_copies_beyond_radius_2(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join(words[:50] + ["other", "words"] + words[52:])]
    a, b = (simhash.fingerprint(t.encode()) for t in texts)
    assert (a ^ b).bit_count() > 2 and _kept(texts) == [0]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [0]


@pytest.mark.parametrize("bucket", [8192, 6])
def test_stage_against_all_pairs(spark, monkeypatch, bucket):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(simhash, "PIVOTS", min(bucket, 64) // 2)
    passage = [f"p{i}" for i in range(40)]
    texts = ["", None, " \n", "one two", "One two", "two one"]
    for _ in range(12):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 120))]
        texts += [" ".join(_damaged(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.08]))) for _ in range(14)]
        texts.append(" ".join(base[:30] + passage))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == _kept(texts)


def test_stage_against_all_pairs_of_known_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = [rows[i][0] for i in _kept([t for _, t in rows])]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()) == want


def test_prefixes_meet():
    """Sets of the least similarity share a shingle of their prefixes, whatever the counts."""
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randrange(1, 60)
        both = [rng.randrange(10**18) for _ in range(n)]
        more = n // 4
        a = np.unique(np.array(both + [rng.randrange(10**18) for _ in range(rng.randint(0, more))], np.int64))
        b = np.unique(np.array(both + [rng.randrange(10**18) for _ in range(max(0, more - (len(a) - n)))], np.int64))
        counts = np.array([rng.randrange(5) for _ in range(simhash.CELLS)])
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, counts), simhash.prefix(b, counts)))


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_any_radius_is_exact(spark, radius):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 9)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    up = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= radius and up[i] != up[j]:
                lo, hi = sorted((up[i], up[j]))
                up = [lo if u == hi else u for u in up]
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.link_edges(nodes, radius)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == up


def test_a_row_without_an_id_links_others(spark, monkeypatch):
    prints = {"a": 0, "b": 3, "c": 15}
    monkeypatch.setattr(simhash, "fingerprint_column", lambda text, width: F.when(text == "a", 0).when(text == "b", 3).otherwise(15).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["fp"], r["component_id"]) for r in got) == [(v, 1) for v in sorted(prints.values())]


def test_stage_keeps_rows_with_odd_ids(spark):
    long = "a text of six words or {} more than that".format
    rows = [(None, long("few"), "en"), (None, "another text altogether that stands by itself", "en"), (5, "one text that has this id", None), (5, "quite another one of the same id", None), (6, long("few"), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[4], *rows[1:4]]))


def _batches(rows, names, size):
    columns = list(zip(*rows))
    return [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], names=names) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_leaders_of_long_files_lose_no_neighbour(monkeypatch, size):
    """Small files find their smallest neighbour; rows of a large one all stay, near its smallest nodes or not."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 40)
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(size)
    prints = [rng.getrandbits(63) for _ in range(4)]
    rows = sorted((t, rng.getrandbits(40), rng.choice(prints) ^ (1 << rng.randrange(63))) for t in [1] * 5 + [2] * 30 + [3] * 200 + [4] * 2 + [5] + [6] * 39)
    got = {(r["token"], r["node"]): r["leader"] for b in simhash._leaders(iter(_batches(rows, ["token", "node", "fp"], size)), 2) for r in b.to_pylist()}
    for t, node, fp in rows:
        near = [n for u, n, f in rows if u == t and n != node and (f ^ fp).bit_count() <= 2]
        if t == 3:
            pivots = [n for u, n, f in rows if u == 3][:3]
            assert got[t, node] == min([node, *(n for n in near if n in pivots)])
        else:
            assert got.get((t, node)) == (min([node, *near]) if near else None)


@pytest.mark.parametrize("bucket", [4, 9, 1000])
def test_pairs_of_slices_are_complete(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = random.Random(bucket)
    rows = [(t, i, 0, g) for t, n in ((1, 40), (2, 5), (3, 20)) for i, g in enumerate([0] * (n // 2) + [rng.randrange(1, 6) for _ in range(n - n // 2)])]
    got = simhash._dealt_across(spark.createDataFrame([*rows, (9, 1, 0, 7), (9, 2, 0, 7)], "token long, node long, fp long, group long")).collect()
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((r["node"], r["group"]))
    token = {r["file"]: None for r in got}
    assert len(token) == len(files) and all(len(f) <= max(4 * bucket, 20) for f in files.values())
    want = {frozenset((a, b)) for t in (1, 2, 3) for u, a, _, g in rows for v, b, _, h in rows if u == v == t and g != h}
    assert {frozenset((a, b)) for f in files.values() for a, g in f for b, h in f if g != h} == want


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 400))) for _ in range(2))
        b = np.union1d(b, a[: rng.integers(0, len(a) + 1)])
        apart = int(np.bitwise_count(np.frombuffer(simhash.parity(a), np.uint8) ^ np.frombuffer(simhash.parity(b), np.uint8)).sum())
        assert apart <= len(np.setxor1d(a, b)) and apart % 2 == len(np.setxor1d(a, b)) % 2
