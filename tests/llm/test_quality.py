"""Quality scores of the query against a plain scorer."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from rowstrata.llm import quality, queries


def plain_margin(model, text):
    """Square roots of the shares of hashed words and of hashed shapes, and the three lengths, times the weights."""
    words = text.split()
    half, base, total = quality.DIMS // 2 - 4, quality.DIMS - 4, len(words)
    shares = Counter()
    for w in words:
        shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w))
        shares[zlib.crc32(w.lower().encode()) % half] += 1
        shares[half + zlib.crc32(shape.encode()) % half] += 1
    out = sum(model.weights[i] * math.sqrt(n / total) for i, n in shares.items())
    out += model.weights[base] * math.log1p(total) / 8 + model.weights[base + 1] * (len(set(words)) / total if total else 1.0)
    return out + model.weights[base + 2] * (total < 10)


def test_op3_against_a_plain_scorer(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality.learn(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.QUERIES["op3_quality"](spark, folder).collect()
    assert len(rows) == len(texts) and model.grades == (0, 1, 2)
    for r in rows:
        tails = [1 / (1 + math.exp(t - plain_margin(model, texts[r["doc_id"]]))) for t in model.thresholds]
        assert all(abs(a - b) < 1e-9 for a, b in zip((r["tail_1"], r["tail_2"], r["expected_grade"]), (*tails, sum(tails))))
        assert r["kept"] == (r["tail_1"] >= 0.5)
