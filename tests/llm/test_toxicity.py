"""Toxicity scores against a plain scorer, and held-out documents of each language."""

from __future__ import annotations

import math
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from rowstrata.llm import queries, toxicity


def plain_margin(model, piece):
    """The margin of a word between edges, triple by triple."""
    weights = dict(zip(model.triple_ids.tolist(), model.triple_weights.tolist()))
    phi = {}
    codes = [int(toxicity._CODES[min(ord(c), 0xFFFF)]) for c in piece]
    for i, j, k in combinations(range(len(codes)), 3):
        t = (codes[i] * 64 + codes[j]) * 64 + codes[k]
        phi[t] = phi.get(t, 0.0) + toxicity.DECAY ** (k - i + 1)
    if not phi:
        return model.offset
    return sum(v * weights.get(t, 0.0) for t, v in phi.items()) / math.sqrt(sum(v * v for v in phi.values())) + model.offset


def plain_score(model, text, memory):
    words = toxicity.units(text)
    for w in words:
        if w not in memory:
            memory[w] = max(0.0, max((plain_margin(model, p) for p in toxicity.spans(w)), default=-9.0) - toxicity.FLOOR)
    best = 0.0
    for at in range(len(words)):
        passage = {w: memory[w] for w in words[at : at + toxicity.PASSAGE]}
        best = max(best, sum(sorted(passage.values(), reverse=True)[: toxicity.TOP]))
    return 1 / (1 + math.exp(-(model.slope * min(best, toxicity.ENOUGH) + model.shift)))


def test_op10_against_a_plain_scorer(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts, memory = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    rows = queries.QUERIES["op10_toxicity"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]]) < 3000:
            assert abs(r["score"] - plain_score(model, texts[r["doc_id"]], memory)) < 1e-4
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_documents_of_each_language():
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    rows = duckdb.sql(f"SELECT doc_id, lang, text, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    own = [r for r in rows if not held(r)]
    model = toxicity.train([r[2] for r in own], [r[3] for r in own])
    own = [r for r in rows if held(r)]
    marked = model.score(np.array(toxicity.Scorer(model).texts(r[2] for r in own))) >= toxicity.THRESHOLD
    clean = [m for m, r in zip(marked, own) if not r[3]]
    assert sum(clean) <= 0.01 * len(clean)
    found = {lang: [m for m, r in zip(marked, own) if r[3] and r[1] == lang] for lang in ("en", "de", "es", "fr")}
    assert all(sum(m) >= 0.75 * len(m) for m in found.values())
    assert sum(map(sum, found.values())) >= 0.85 * sum(map(len, found.values()))


def test_the_worst_passage_counts():
    words = ["bad", "x", "bad", "worse", "x", "worst", "least"]
    weights = [1.0, 0.0, 1.0, 2.0, 0.0, 3.0, 0.5]
    assert toxicity.passage_evidence(words, weights) == 6.0
    assert toxicity.passage_evidence([], []) == 0.0
    far = ["bad"] + ["x"] * toxicity.PASSAGE + ["worse"]
    assert toxicity.passage_evidence(far, [1.0] + [0.0] * toxicity.PASSAGE + [2.0]) == 2.0


def test_letters_may_be_put_in():
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    rows = duckdb.sql(f"SELECT text, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE lang = 'en' ORDER BY doc_id LIMIT 900").fetchall()
    model = toxicity.train([r[0] for r in rows], [r[1] for r in rows])
    score = lambda *texts: model.score(np.array(toxicity.Scorer(model).texts(texts)))
    assert (score("an idiot", "an id-iot", "an i d i o t", "an idiiot", "scum") > 0.6).all()
    assert (score("a plain sentence of words", "the station", "") < 0.3).all()
