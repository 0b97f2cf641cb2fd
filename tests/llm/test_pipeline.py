from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowstrata.llm import queries

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


NAMES = ["__score", "__id", "__copies", "__copy", "__rules_kept", "____rules_text", "n_words", "kept", "position", "node", "root", "__near_row", "__mix_row", "key", "size"]


def test_stages_carry_columns_of_any_name(spark, small):
    """Values, not names alone: each row keeps its own."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for n in NAMES:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.simhash.common.store(stage(spark, docs, small), "test")
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES) and all(r["m"] == {"k": r["doc_id"]} for r in rows), name


def test_mixing_takes_rows_without_ids_and_repeated_ones(spark):
    docs = spark.createDataFrame([(None, "a b c", "x"), (None, "d e f", "x"), (3, "g h", "x"), (3, "g h", "x"), (4, None, "x"), (5, "", None)], "doc_id long, text string, source string")
    got = [r["text"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    # one source takes 1.5 times its 10 words in whole documents
    assert set(got) == {"a b c", "d e f", "g h"} and got.count("g h") >= 2 and 13 <= sum(len(t.split()) for t in got) <= 17


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).collect() == []


def test_stages_keep_the_columns_and_shrink(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("__score", F.lit("mine"))
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        docs = queries.simhash.common.store(docs, "test")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    rows = [(5, "one two three four five six", "en", "s", 1)] * 3 + [(9, "One two three four five six", "en", "s", 1), (7, "something else altogether is here", "en", "s", 1), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [5, 7, 8]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    show = lambda rows: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert show(tuple(r) for r in got.select(*names).collect()) == show(want.fetchall())


def _taken_whole(docs):
    """Copies of each doc_id by the mixing rule, in plain Python."""
    size = {d["doc_id"]: len(_WORD.findall(d["text"] or "")) for d in docs}
    total = {}
    for d in docs:
        total[d["source"]] = total.get(d["source"], 0) + size[d["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else level * weight[s]
            left -= target[s]
        free -= over or free
    copies = {}
    for s in order:
        own = sorted((d["doc_id"] for d in docs if d["source"] == s), key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i))
        at = 0
        for again in (0, 1):
            for i in own:
                if round(target[s]) - at > size[i] / 2 and size[i]:
                    copies[i] = copies.get(i, 0) + 1
                at += size[i]
    return copies


def test_pipeline_against_brute_force(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    frame, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    learned = queries.rules.learn(frame, labels)
    measured = {r["doc_id"]: r for r in queries.rules.judge(frame, learned).collect()}
    left = []
    for d in docs:
        words = _WORD.findall(d["text"])
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = len({i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)})
        m = measured[d["doc_id"]]
        assert (m["n_words"], m["n_repeat_words"]) == (len(words), repeated)
        share = lambda t: m[queries.rules.RATIOS[t.name][0]] / max(1, m[queries.rules.RATIOS[t.name][1]])  # noqa: B023, E731
        if len(words) >= 10 and 100 * repeated <= 20 * len(words) and not any(all(t.holds(share(t)) for t in r.tests) for r in learned):
            left.append(d)
    model = queries.toxicity.learn(spark.createDataFrame(left, frame.schema), labels)
    if model is not None:
        scores = model.score(queries.toxicity.np.array(queries.toxicity.Scorer(model).texts(d["text"] for d in left)))
        left = [d for d, s in zip(left, scores) if s < queries.toxicity.THRESHOLD]
    left.sort(key=lambda d: d["doc_id"])
    # near copies: five words, a Jaccard similarity of 0.8 or more
    grams = []
    for d in left:
        words = d["text"].encode().lower().split()
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    left = [d for i, d in enumerate(left) if group[i] == i]
    copies = _taken_whole(left)
    encoder = queries.packing.WordEncoder(queries.packing.tokenizer_path())
    want = Counter({d["doc_id"]: (len(next(encoder.encode([d["text"].encode()]))) // 4 + 1) * copies[d["doc_id"]] for d in left if d["doc_id"] in copies})
    got, used = Counter(), {}
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]] += r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for spans in used.values():
        ends = [0]
        for offset, length in sorted(spans):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
