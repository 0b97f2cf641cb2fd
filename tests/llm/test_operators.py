"""Each operator on small tables: against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowstrata.llm import chat, common, media, mixing, packing, quality, rules, sharding, simhash, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", "one two\u00a0three four", "A b c d e\nA b c d e\n\nA b c d e", "same text here", "same text here", "ünï \U0001f600 \x0b#$%", LONG]


def documents(spark, texts=TEXTS, extra=True):
    """Odd rows: null ids and sources, a repeated row, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, "src1", None), rows[6]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("size", "score", "fp", "media", "key", "n_words", "slot", "payload", "length", "__text", "h", "shard", "target")})
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- op1


def test_media_round_trip_and_index(spark):
    got = {r["id"]: r for r in rows_of(media.index_media(media.encode_media(documents(spark))))}
    for i, t in enumerate(TEXTS):
        body = (t or "").encode()
        assert got[i]["error"] is None
        track = got[i]["tracks"][0]
        frames = max(1, -(-len(body) // 64))
        assert (track["codec"], track["duration"], track["samples"]) == ("raw ", frames, frames)
        data = media.build_container(media.padded(body))
        assert media.read_payload(data, media.read_tracks(data)[0]) == media.padded(body)
        assert [k["offset"] for k in track["keyframes"]] == [len(data) - frames * 64 + k * 64 for k in range(0, frames, 32)]
    assert rows_of(media.encode_media(empty(spark))) == []


@given(st.binary(max_size=9000))
@settings(max_examples=30, deadline=None)
def test_container_holds_any_payload(payload):
    data = media.build_container(media.padded(payload))
    assert media.read_payload(data, media.read_tracks(data)[0]) == media.padded(payload)


def test_broken_containers_are_reported(spark):
    whole = media.build_container(media.padded(b"x" * 5000))
    cut = [whole[:n] for n in (0, 7, 60, len(whole) - 1)] + [b"\0\0\0\4free", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cut)], "id long, media binary")
    got = {r["id"]: r for r in rows_of(media.index_media(df))}
    assert got[3]["error"] and got[4]["error"] and got[1]["error"]
    assert got[0]["tracks"] == [] and got[5]["tracks"] == []


def test_media_tables_of_other_writers():
    """stco, a sample size table, two samples a chunk and an interleaved gap."""
    f, b = media._full, media._box
    samples = [b"aaa", b"bb", b"cccc"]
    stbl = lambda at: b(b"stbl", f(b"stsd", 0, 0, struct.pack(">I", 1), b(b"avc1", bytes(70))), f(b"stsc", 0, 0, struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), f(b"stsz", 0, 0, struct.pack(">II3I", 0, 3, 3, 2, 4)), f(b"stco", 0, 0, struct.pack(">3I", 2, at, at + 9)), f(b"stss", 0, 0, struct.pack(">3I", 2, 1, 3)))
    moov = lambda at: b(b"moov", b(b"trak", b(b"mdia", f(b"mdhd", 0, 0, struct.pack(">4I", 0, 0, 90, 270)), b(b"minf", stbl(at)))))
    at = len(moov(0)) + 8
    data = moov(at) + b(b"mdat", b"aaabb....cccc")
    (t,) = media.describe(data)
    assert (t["codec"], t["timescale"], t["duration"]) == ("avc1", 90, 270)
    assert t["keyframes"] == [{"offset": at, "length": 3}, {"offset": at + 9, "length": 4}]
    assert media.read_payload(data, media.read_tracks(data)[0]) == b"".join(samples)


# ---- op2


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    texts = [" ".join("w" * 1 for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(i, t, ["a", "b", "c", "d", None][min(4, int(rng.random() ** 2 * 5))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.assign(docs))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # reshare until none is above
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert r["take1"] + r["take2"] <= 2 * r["size"]
        assert (r["position1"] is None) == (r["take1"] == 0)
        taken[r["source"]] += r["take1"] + r["take2"]
    assert {s: round(t) for s, t in target.items()} == dict(taken)
    assert got and sorted(map(str, got)) == sorted(map(str, rows_of(mixing.assign(docs.repartition(7)))))
    positions = [r["position"] for r in rows_of(mixing.mix(docs))]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    whole = rows_of(mixing.assign(docs, partial=False))
    assert all(r[k] in (0, r["size"]) for r in whole for k in ("take1", "take2"))


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        spent = mixing.areas(knots)
        got = spark.range(101).select(mixing.inverse(F.col("id") / 100, knots).alias("t")).collect()
        for i, r in enumerate(got):
            grid = np.linspace(0, r["t"], 2001)
            area = np.trapezoid(np.interp(grid, *zip(*knots)), grid)
            assert math.isclose(area, i / 100 * spent[-1], abs_tol=1e-5)


def test_mixing_odd_rows(spark):
    assert len(rows_of(mixing.assign(documents(spark)))) == len(TEXTS) + 2
    assert rows_of(mixing.assign(empty(spark))) == []
    assert rows_of(mixing.mix(empty(spark))) == []


# ---- op3


def test_ordinal_model_ranks_grades(spark):
    rng = random.Random(2)
    good, bad, mid = "alpha beta gamma delta", "### !!! ***", "alpha beta ### !!!"
    texts = [" ".join(rng.choices((bad, mid, good)[g].split(), k=30)) for g in [i % 3 for i in range(300)]]
    model = quality.train(texts, [i % 3 for i in range(300)])
    assert all(np.diff(model.thresholds) > 0)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:60], None, ""])], "doc_id long, text string")
    got = df.select("doc_id", quality.score_column(model, F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    grade = {r["doc_id"]: r["expected_grade"] for r in got}
    assert max(grade[i] for i in range(0, 60, 3)) < min(grade[i] for i in range(2, 60, 3))
    assert grade[60] == grade[61]
    assert all(a >= b for r in got for a, b in zip(r["tails"], r["tails"][1:]))
    assert quality.train([], []) is None and quality.train(["a", "b"], [1, 1]).tails(np.zeros(2)).shape == (2, 0)


def test_ordinal_gradient_reaches_the_likelihood_of_the_shares():
    """Without features that tell, thresholds approach the logits of the shares."""
    grades = [0] * 50 + [1] * 30 + [2] * 20
    model = quality.train(["same words all over here"] * 100, grades, epochs=60)
    f = quality.Features()
    i, v = f.of("same words all over here")
    tails = model.tails(np.array([model.weights[i] @ v]))[0]
    assert np.allclose(tails, [0.5, 0.2], atol=0.05)


# ---- op4


def test_reachable_equals_a_walk():
    rng = random.Random(3)
    for n in (0, 1, 2, 50):
        offsets = np.array(sorted({0, *rng.sample(range(1000), n)}) if n else [], np.int64)
        successors = np.array([int(rng.choice([*offsets[offsets > o], o + 1, 5000])) for o in offsets], np.int64)
        walk, at = set(), 0
        step = dict(zip(offsets.tolist(), successors.tolist()))
        while at in step:
            walk.add(at)
            at = step[at]
        assert set(offsets[warc.reachable(offsets, successors)].tolist()) == walk


def test_warc_rejects_magic_in_payloads(spark):
    fake = warc.build_record(99, "http://fake/", b"y" * 500, "0" * 64, None, False).decode()
    bodies = [None, "", "short", "x" * 100, "x" * 100, fake * 3, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40, "ü" * 300_000, "x" * 99, "x" * 99]
    rows = [(i, None if i == 2 else f"http://a b/{i}" + "z" * 20_000 * (i == 3), h, "extra", 1) for i, h in enumerate(bodies)] + [(3, "u", "x" * 100, "extra", 2), (None, "u", "x" * 100, "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, offset long").repartition(4)
    manifest = warc.write_archives(warc.plan_records(pages), common.fresh_path(spark, "warc-test"), archive_bytes=200_000)
    back = rows_of(warc.read_archives(manifest, split_bytes=70_001))
    assert len(back) == len(rows) and all(r["complete"] for r in back)
    got = defaultdict(list)
    for r in back:
        got[r["record_id"]].append(r)
    for i, h in enumerate(bodies):
        body = (h or "").encode()
        for r in got[f"<urn:x-page:{i}>"]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert [r["record_type"] for r in got["<urn:x-page:3>"]] == ["response"] * 2
    assert got["<urn:x-page:4>"][0]["refers_to"] == got["<urn:x-page:None>"][0]["refers_to"] == "<urn:x-page:3>"
    assert got["<urn:x-page:9>"][0]["record_type"] == "response"
    assert warc.candidates(manifest, 70_001).count() > len(rows)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows_of(warc.read_archives(warc.write_archives(warc.plan_records(none), common.fresh_path(spark, "warc-none")))) == []


# ---- op5


def test_hash_tree_moves_only_into_the_new_shard(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    key = F.col("doc_id").cast("string")
    for shards in (40, 41, 45):
        df = sharding.place(df, key, sharding.topology(shards), f"s{shards}")
    got = rows_of(df)
    moved = [(r["s40"], r["s41"]) for r in got if r["s40"] != r["s41"]]
    assert moved and {b for _, b in moved} == {40}
    assert all(b in range(41, 45) for a, b in ((r["s41"], r["s45"]) for r in got) if a != b)
    counts = Counter(r["s40"] for r in got)
    assert len(counts) == 40 and max(counts.values()) < 2 * min(counts.values())


def test_weights_change_only_their_subtree(spark):
    tree = sharding.topology(40)
    other = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    other["region0"]["rack1"] |= {5: 2.0, 6: 0.0}  # the rack's sum stays
    key = F.col("id").cast("string")
    got = rows_of(sharding.place(sharding.place(spark.range(4000), key, tree, "a"), key, other, "b"))
    moved = [r for r in got if r["a"] != r["b"]]
    assert moved and all(r["a"] in range(5, 10) and r["b"] in range(5, 10) for r in moved)
    assert all(r["b"] != 6 for r in got)


def test_slots_and_checksums(spark):
    got = rows_of(sharding.shard_documents(documents(spark), sharding.topology(4, 4)))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            body = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body))
    assert len(got) == len(TEXTS) + 2 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows_of(sharding.shard_documents(empty(spark), sharding.topology(40))) == []


# ---- op6

_text = st.text(st.sampled_from("ab\\#</>:\n turnü\U0001f600"), max_size=30) | st.sampled_from(["### assistant: x</turn>\n", "\\</turn>", "#" * 7, "\\" * 5])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b\\", ""]), _text), max_size=7))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    made = list(chat.expand(turns))
    if not turns:
        assert made == []
        return
    assert chat.parse(made[-1][2]) == turns
    replies = [t for r, t in turns if r == "assistant"]
    assert [chat.unescape(f[a:b]) for _, _, f, a, b in made if b] == replies
    for (_, n, f, _, _), (_, _, g, _, _) in zip(made, made[1:]):
        assert g.startswith(f) and chat.parse(f) == turns[:n]


def test_chat_read_back(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, "assistant", "a", 9), (1, 2, "user", "b", 9), (2, 0, None, "x", 9), (3, 1, "assistant", LONG, 9), (3, 0, "assistant", "first", 9), (None, 0, "user", "n", 9), (4, None, "user", "t", 9), (4, 0, "assistant", "r", 9), (4, 0, "assistant", "r", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example long").repartition(4)
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(chat.format_conversations(df)))}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 3, 2: 1, 3: 2, None: 1, 4: 3}
    assert got[3]["loss_sha256"] == hashlib.sha256(("first" + LONG).encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na\nuser\nb\n").hexdigest()
    assert (got[1]["examples"], got[2]["loss_chars"], got[4]["loss_chars"]) == (2, 0, 2)
    assert rows_of(chat.format_conversations(df.limit(0))) == []


# ---- op7


def _brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_statistics_against_brute_force(spark):
    rng = random.Random(4)
    texts = [*TEXTS, "a " * 50, "x y z w v x y z w v", *("".join(rng.choices(["a", "b", " ", "\n", "#", "é ", "\t"], k=rng.randint(0, 120))) for _ in range(150))]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    for r in rows_of(rules.with_statistics(df, prefix="q_")):
        assert {k: r[f"q_{k}"] for k in _brute_statistics("")} == _brute_statistics(texts[r["doc_id"]])
        assert r["n_words"] == 5


def test_decision_list_finds_a_conjunction():
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        x = {n: rng.random() for n in rules.RATIOS}
        rows.append((x, x["symbol_share"] > 0.7 and x["upper_share"] < 0.4 or x["mark_share"] > 0.9))
    learned = rules.learn_list(rows)
    caught = [any(all(t.holds(x[t.name]) for t in r.tests) for r in learned) for x, _ in rows]
    assert sum(c != y for c, (_, y) in zip(caught, rows)) < 0.03 * len(rows)
    assert rules.learn_list([]) == [] and rules.learn_list([(rows[0][0], True)] * 3) == []


def test_judge_follows_the_ordered_list(spark):
    learned = [rules.Rule((rules.Test("symbol_share", True, 0.1),), 1.0, 9), rules.Rule((rules.Test("upper_share", True, 0.5), rules.Test("repeat_share", False, 0.5)), 1.0, 9)]
    texts = ["# " * 12 + "w", "ABC DEF " * 2 + " ".join("UVWXYZ"), "plain words " + " ".join(map(str, range(20))), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["rule"], r["kept"]) for r in rows_of(rules.judge(df, learned))}
    assert got[1] == (2, False) and got[2] == (0, True) and got[0][0] == 1 and got[3] == (0, False)
    plan = rules.judge(df, learned).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rows_of(rules.judge(documents(spark, extra=False), []).where("kept and doc_id is null")) == []


def test_rules_learn_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.learn(documents(spark), none) == []
    some = spark.createDataFrame([(3, None, None), (None, 1, 1), (4, 1, None)], none.schema)
    assert rules.learn(documents(spark), some) == []


# ---- op8


def _brute_best_fit(lengths, window):
    left, out = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits and n < window:
            r, i = min(fits)
        else:
            i = len(left)
            left.append(window)
        out.append(left[i])
        left[i] -= n
    return out, len(left)


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=80, deadline=None)
def test_best_fit_against_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 50)
    remaining, count = _brute_best_fit(lengths, 50)
    assert [50 - o for o in offsets] == remaining and len(set(windows)) == count
    used = defaultdict(int)
    for w, o, n in zip(windows, offsets, lengths):
        assert used[w] == o
        used[w] += n
    assert all(u <= 50 for u in used.values())


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [*(t or "" for t in TEXTS[:-1]), "Don't it's <|endoftext|> x2y ÀÉ œuvre. İstanbul ΣΑΣ e\u0301 é 'tis they'll!!,. ##a ﬁ ...end", "<|ENDOFTEXT|> <|endoftext|>,", "ŉa Ǆ ǅ ſ ×÷ a·b ª", "\u2028x\u3000y\x85z\x1c"]
    for text, got in zip(texts, packing.WordEncoder(path).encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    small = packing.WordEncoder(path, size=3)
    assert b"".join(small.encode([b"a b c d e", b"f g h"])) == b"".join(packing.WordEncoder(path).encode([b"a b c d e", b"f g h"]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_vocabulary_encodes_as_its_tokenizer(name):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(name)
    tokenizer, texts = Tokenizer.from_file(path), ["", "Plain Words, here.", " two  blanks\nand a line", "ÄÖ ünï İ ſ don't we'll 1234", "<|endoftext|> x", "\u3000wide\xa0blank"]
    encoder = packing.WordEncoder(path)
    assert encoder.by_word == (name == "word_bpe_49k.json")
    got = [np.frombuffer(i, "<u4").tolist() for i in encoder.encode([t.encode() for t in texts])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_rows_fill_many_bins(spark):
    docs = spark.createDataFrame([(7, "the same few words again")] * 3000, "doc_id long, text string")
    got = packing.pack_documents(docs, group_tokens=4096).toPandas()
    assert got["sequence_id"].floordiv(1 << 32).nunique() > 1 and len(got) == 3000
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096


def test_packing_is_whole(spark):
    got = rows_of(packing.pack_documents(documents(spark), window=64, group_tokens=2000, with_ids=True))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 256
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    enc = packing.WordEncoder(packing.tokenizer_path())
    for i, t in enumerate(TEXTS):
        whole = next(enc.encode([(t or "").encode()])) + (2).to_bytes(4, "little")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        if i != 6:  # that row is there twice
            assert b"".join(p["ids"] for p in pieces) == whole and all(p["doc_tokens"] == len(whole) // 4 for p in pieces)
    assert rows_of(packing.pack_documents(empty(spark))) == []


# ---- op9


def _brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_spark_hash(spark):
    texts = [*TEXTS[:-1], "The Quick ÄÖ brown FOX jumps", "a b", "x " * 5]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [_brute_fingerprint(t) for t in texts]
    row = spark.createDataFrame([("a shingle of words",)], "s string").select(F.xxhash64("s")).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest(b"a shingle of words", 42)


def _components(fps, ids, radius=2):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [8192, 20])
def test_components_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains of near ones, in a few families that share many bits
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(16)))
    fps = list(dict.fromkeys(fps))
    ids = rng.sample(range(10_000), len(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.link_edges(nodes)).collect()}
    want = _components(fps, ids)
    assert {i: got.get(i, i) for i in ids} == want


def test_tiles_skip_nothing():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**63, 700, dtype=np.uint64)
    fps = np.unique(np.r_[fps, fps[:200] ^ np.uint64(5)])
    got = {(min(a, b), max(a, b)) for x, y in simhash.tile_links(fps, tile=64) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_long_chain_and_star(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 200))


def test_simhash_odd_rows(spark):
    got = rows_of(simhash.near_duplicates(documents(spark)))
    assert len(got) == len(TEXTS) + 2
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert all(len(v) == 1 for v in by.values())
    assert by[0] == by[1] == by[2] == {(0, 0)} and next(iter(by[7]))[1] == 6
    assert rows_of(simhash.near_duplicates(empty(spark))) == []


# ---- op10


def _insulting(rng, n):
    clean = ["".join(rng.choices(["the", "an", "ti", "on", "er", "ou", "re"], k=rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=60)
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randrange(60), rng.choice(["blarfus", "mungwit"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_kernel_against_recursion():
    def phi(s):
        out = defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    words = ["idiot", "idxiot", "iddiioott", "abcdefgh", "ab", "idi"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = phi(a), phi(b)
            dot = sum(v * y[k] for k, v in x.items())
            norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert math.isclose(got[i, j], dot / norm if norm else 0.0, abs_tol=1e-9)


def test_toxicity_learns_and_tolerates_gaps(spark):
    texts, labels = _insulting(random.Random(8), 600)
    model = toxicity.train(texts, labels)
    held, truth = _insulting(random.Random(9), 200)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*held, "you b-l-a-r-f-u-s", "oh m u n g w i t", None, "", "blarfus" * 40])], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["predicted"] for r in rows_of(toxicity.score_documents(df, model))}
    assert sum(got[i] != y for i, y in enumerate(truth)) <= 2
    assert (got[200], got[201], got[202], got[203], got[204]) == (1, 1, 0, 0, 1)
    assert toxicity.train(["a b"], [0]) is None
    assert {r["score"] for r in rows_of(toxicity.score_documents(documents(spark), None))} == {0.0}
    assert rows_of(toxicity.score_documents(empty(spark), model)) == []


def test_scores_do_not_depend_on_batches():
    texts, labels = _insulting(random.Random(8), 300)
    model = toxicity.train(texts, labels)
    once = toxicity.Scorer(model).texts(texts)
    assert np.allclose(once, toxicity.Scorer(model, size=50).texts(texts, together=500))


# ---- shared helpers


def test_bucketed_prefix(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), common.md5_key(F.col("id").cast("string")).alias("key"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = rows_of(common.bucketed_prefix(common.store(df, "t"), ["g"], "key", ["id"], "v", "before", "t"))
    for g in range(3):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["key"], r["id"])):
            assert r["before"] == total
            total += r["v"]


def test_stored_tables_can_be_dropped(spark):
    path = common.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert common.drop_stored(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
