"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel is the gap-weighted subsequence kernel of Lodhi et al. (2002): two
strings are alike by the subsequences of three letters that they share, each
weighed by decay to the power of the span it covers. Gaps and inserted letters
cost weight, not the match. Words are compared with their edges, as letters.

Training rows are sentences of labelled documents, by multiple-instance learning:
a sentence stands for its words and is represented by one of them. A sentence of a
toxic document is a positive row if it holds a *witness*, a word with a piece that
toxic documents have far more often than chance allows, and its witnesses represent
it. Every sentence of a clean document is a negative row, represented by its worst word
under the machine so far; the machine is learned again until no representative
changes. As it is linear in the landmarks' kernels, it folds into one weight per letter
triple, so scoring costs no kernel per landmark.

A passage of ``PASSAGE`` words scores by its ``TOP`` worst different words (or runs of
spelled-out letters), a document by its worst passage: one clear insult marks it, and so do a few
doubtful ones that stand together, where a long clean text holds single ones by chance.
Scores are calibrated on labelled documents that a first machine hasn't learned from.

Defined results: a null or empty text scores like one without a doubtful word; words
longer than ``SPAN`` are scored in overlapping windows, whole texts always; repeated
rows score alike; labels that are null are not learned from; without labels of
both kinds every score is 0; extra columns are ignored or carried through.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 3
DECAY = 0.6
LETTERS = 64
SPAN = 24
#: What stands before and after a word.
EDGE = "\x01"
#: Fit parameter: the rank of the kernel's approximation.
LANDMARKS = 320
#: Labelled documents that are learned from, at most: clean and toxic ones; and their characters.
SAMPLE = (3000, 2000)
SAMPLE_CHARS = 64 << 20
#: Fit parameters: letters of a witness's piece, an edge included, at least; toxic documents that have it; the chance that any piece is one by accident.
LEAST_PIECE, LEAST_DOCUMENTS, CHANCE = 5, 3, 0.05
#: Fit parameters: what variants with an inserted letter weigh, how many a witness has; the ridge of the machine; its rounds at most.
NOISE_WEIGHT, VARIANTS, RIDGE, ROUNDS = 0.3, 2, 0.1, 12
#: A word counts by its margin above this, in passages of so many words, by so many words.
FLOOR, PASSAGE, TOP = -0.5, 256, 3
#: Evidence beyond which a document is as good as certain, so that more of it adds nothing.
ENOUGH = 2.5
THRESHOLD = 0.7
#: Words whose score a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 400_000
SENTENCE = re.compile(r"[.!?\n]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[\s._*-]+\w){3,}(?!\S)")
_NO_LETTER = re.compile(r"[\W_]+")

_CODES = np.zeros(0x10000, np.int32)
for _c in range(0x10000):
    if chr(_c).isalnum():
        _CODES[_c] = _c - 96 if 97 <= _c <= 122 else 28 + _c % (LETTERS - 28)
_CODES[ord(EDGE)] = 27


def units(text: str) -> list[str]:
    """The scored strings of a text: its words in lower case, and runs of single letters joined."""
    low = text.lower()
    return low.split() + [_NO_LETTER.sub("", m[0]) for m in _SPELLED.finditer(low)]


def spans(word: str) -> list[str]:
    """A word's letters between edges, in windows of ``SPAN`` that overlap by half; none without letters."""
    if not word.isalnum():
        word = _NO_LETTER.sub("", word)
    if not word:
        return []
    word = f"{EDGE}{word}{EDGE}"
    if len(word) <= SPAN:
        return [word]
    return [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def encode(words: list[str]) -> np.ndarray:
    """Letter codes of words of one length, a column each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return np.ascontiguousarray(_CODES[np.minimum(points, 0xFFFF)].T)


def self_kernel(codes: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """K(w, w) of words of one length, by the dynamic program over both positions."""
    n, b = codes.shape
    decay = kind(DECAY)
    same = (codes[:, None, :] == codes[None, :, :]) * (decay * decay)
    prior = np.ones((n + 1, n + 1, b), kind)
    for order in range(1, ORDER):
        now = np.zeros((n + 1, n + 1, b), kind)
        for i in range(1, n + 1):
            step, run = same[i - 1] * prior[i - 1, :-1], np.zeros(b, kind)
            for j in range(1, n + 1):
                run = decay * run + step[j - 1]
                now[i, j] = decay * now[i - 1, j] + run
        prior = now
    return (same * prior[:-1, :-1]).sum(axis=(0, 1), dtype=np.float64)


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(packed letters, weight) of every choice of three positions."""
    n = len(codes)
    first = codes * (LETTERS * LETTERS)
    for i, j in combinations(range(n - 1), 2):
        pair = first[i] + codes[j] * LETTERS
        for k in range(j + 1, n):
            yield pair + codes[k], DECAY ** (k - i + 1)


def by_length(words: Iterable[str], most: int = 4096) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n in sorted(groups):
        for at in range(0, len(groups[n]), most):
            yield groups[n][at : at + most]


def norms(words: list[str]) -> np.ndarray:
    out = np.ones(len(words))
    place = {w: i for i, w in enumerate(words)}
    for group in by_length(place):
        if len(group[0]) >= ORDER:
            out[[place[w] for w in group]] = np.sqrt(self_kernel(encode(group)))
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of different words, words by landmarks."""
    seen: dict[int, int] = {}
    sparse: list[tuple[int, int, float]] = []
    for col, mark in enumerate(landmarks):
        if len(mark) >= ORDER:
            for t, w in triples(encode([mark])):
                sparse.append((seen.setdefault(int(t[0]), len(seen) + 1), col, w))
    index = np.zeros(LETTERS**ORDER, np.int64)
    index[list(seen)] = list(seen.values())
    table = np.zeros((len(seen) + 1, len(landmarks)))
    for row, col, w in sparse:
        table[row, col] += w
    out = np.zeros((len(words), len(landmarks)))
    place = {w: i for i, w in enumerate(words)}
    for group in by_length(place, 512):
        if len(group[0]) >= ORDER:
            got = np.zeros((len(group), len(landmarks)))
            for t, w in triples(encode(group)):
                got += w * table[index[t]]
            out[[place[w] for w in group]] = got
    out /= norms(words)[:, None]
    return out / norms(landmarks)[None, :]


@dataclass(frozen=True)
class Model:
    """Weights of letter triples, the offset, and the logistic map from evidence to scores."""

    triple_ids: np.ndarray
    triple_weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        out = np.zeros(LETTERS**ORDER, np.float32)
        out[self.triple_ids] = self.triple_weights
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(evidence, ENOUGH) + self.shift, -60, 60)))


class Scorer:
    """Margins of words and evidence of texts under a model, with a bounded memory of words."""

    def __init__(self, model: Model, size: int = CACHE_WORDS):
        self.model, self.table, self.size, self.known = model, model.table(), size, {}

    def spans(self, words: Iterable[str]) -> dict[str, float]:
        out = dict.fromkeys(words, self.model.offset)
        for group in by_length(out):
            if len(group[0]) >= ORDER:
                codes = encode(group)
                got = np.zeros(len(group), np.float32)
                for t, w in triples(codes):
                    got += np.float32(w) * self.table[t]
                out.update(zip(group, (got / np.sqrt(self_kernel(codes, np.float32)) + self.model.offset).tolist()))
        return out

    def learn(self, words: Iterable[str]) -> None:
        parts = {w: spans(w) for w in words}
        margins = self.spans({s for p in parts.values() for s in p})
        # a word counts by what it has above the floor, the others not at all
        self.known.update((w, max(0.0, max((margins[s] for s in p), default=FLOOR) - FLOOR)) for w, p in parts.items())

    def texts(self, texts: Iterable[str], together: int = 1 << 20) -> list[float]:
        """The evidence of each text: that of its worst passage. New words are scored for many texts at once."""
        out: list[float] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(units(text))
            size += len(text)
            if size >= together:
                out += self._worst(held)
                held, size = [], 0
        return out + self._worst(held)

    def _worst(self, each: list[list[str]]) -> list[float]:
        known = self.known
        missing = set(chain.from_iterable(each)).difference(known)
        if len(known) + len(missing) > self.size:
            known.clear()
            missing = set(chain.from_iterable(each))
        self.learn(missing)
        get = known.__getitem__
        return [passage_evidence(u, list(map(get, u))) for u in each]


def passage_evidence(words: list[str], weights: list[float]) -> float:
    """The largest sum that the ``TOP`` heaviest different words of a passage have."""
    if not any(weights):
        return 0.0
    hits = [(i, w, words[i]) for i, w in enumerate(weights) if w]
    best, end = 0.0, 0
    inside: Counter[str] = Counter()
    heavy: dict[str, float] = {}
    for at, weight, word in hits:
        inside[word] += 1
        heavy[word] = weight
        while hits[end][0] <= at - PASSAGE:
            gone = hits[end][2]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone], heavy[gone]
            end += 1
        best = max(best, sum(heapq.nlargest(TOP, heavy.values())) if len(heavy) > TOP else sum(heavy.values()))
    return best


def without_copies(docs: list[np.ndarray], codes: np.ndarray, hashes: int = 32) -> list[np.ndarray]:
    """One of each group of near copies, by MinHash agreement of four fifths: copies are no independent evidence.

    A document is its word numbers; ``codes`` has a hash of each word.
    """
    kept: list[np.ndarray] = []
    sketches = np.zeros((len(docs), hashes), np.uint32)
    mixers = np.random.default_rng(5).integers(1, 1 << 32, (2, hashes), dtype=np.uint64)
    for doc in docs:
        own = codes[doc] if len(doc) else np.zeros(1, np.uint64)
        sketch = ((own[:, None] * (mixers[0] | 1) + mixers[1]) >> np.uint64(16)).astype(np.uint32).min(axis=0)
        if not kept or (sketches[: len(kept)] == sketch).sum(axis=1).max() < hashes * 4 / 5:
            sketches[len(kept)] = sketch
            kept.append(doc)
    return kept


def _log_tail(k: int, n: int, share: float) -> float:
    """The logarithm of Chernoff's bound on k or more toxic ones among n documents."""
    p = k / n
    if p <= share:
        return 0.0
    return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if k < n else 0.0))


def find_witnesses(words: list[str], toxic: list[np.ndarray], clean: list[np.ndarray]) -> dict[str, tuple[int, int]]:
    """Words with a piece that toxic documents have beyond chance: (toxic, clean) documents that hold each.

    Documents are numbers of ``words``. A piece is any run of letters of a word, edges included. Pieces are taken the least
    likely by chance first; words that a piece explains count for no other one. Chance is
    divided by the number of words that toxic documents have.
    """
    share = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
    bad: dict[str, set[int]] = {}
    for d, doc in enumerate(toxic):
        for w in doc.tolist():
            bad.setdefault(words[w], set()).add(d)
    bar = math.log(CHANCE / max(1, len(bad)))
    least = max(LEAST_DOCUMENTS, bar / math.log(share))  # fewer toxic documents can't pass, even without a clean one
    # level by level: a piece is frequent only if both pieces one letter shorter are
    words_of: dict[str, list[str]] = {}
    shorter: set[str] | None = None
    n, left = LEAST_PIECE, list(bad)
    while left:
        level: dict[str, list[str]] = {}
        for w in left:
            for p in {w[i : i + n] for i in range(len(w) - n + 1)}:
                if shorter is None or p[1:] in shorter and p[:-1] in shorter:
                    level.setdefault(p, []).append(w)
        shorter = {p for p, own in level.items() if sum(len(bad[w]) for w in own) >= least and len(set().union(*(bad[w] for w in own))) >= least}
        words_of.update((p, level[p]) for p in shorter)
        left = list({w for p in shorter for w in words_of[p]})
        n += 1

    def pieces(w: str) -> set[str]:
        found = set()
        for i in range(len(w) - LEAST_PIECE + 1):
            for j in range(i + LEAST_PIECE, len(w) + 1):
                if (p := w[i:j]) not in words_of:  # no longer one is frequent either
                    break
                found.add(p)
        return found

    good = np.bincount(np.concatenate(clean), minlength=len(words)) if clean else np.zeros(len(words), np.int64)
    against: dict[str, int] = {}
    for i in np.flatnonzero(good).tolist():
        w = words[i]
        if own := pieces(w):
            against[w] = int(good[i])
            for p in own:
                if w not in bad:
                    words_of[p].append(w)
    explained: set[str] = set()

    def strength(p: str) -> float:
        own = [w for w in words_of[p] if w not in explained]
        k = len(set().union(*(bad[w] for w in own if w in bad)))
        return _log_tail(k, k + sum(against.get(w, 0) for w in own), share) if k else 0.0

    queue = [(s, p) for p in words_of if (s := strength(p)) < bar]
    heapq.heapify(queue)
    while queue:
        held, p = heapq.heappop(queue)
        now = strength(p)
        if now < bar and now > held + 1e-9:
            heapq.heappush(queue, (now, p))
        elif now < bar:
            explained.update(words_of[p])
    return {w: (len(bad[w]), against.get(w, 0)) for w in sorted(explained) if w in bad}


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Linear support vector machine (squared hinge loss) by Newton steps; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] *= 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        short = 1 - y * (x @ w.astype(x.dtype))
        a = short > 0
        xa = x[a]
        grad = shrink * w - 2 * (xa.T @ (weight[a] * y[a] * short[a]).astype(x.dtype))
        step = np.linalg.solve(np.diag(shrink) + 2 * ((xa.T * weight[a].astype(x.dtype)) @ xa), grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's map with his smoothed targets, by damped Newton steps."""
    good, bad = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        r, s = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([r @ x + 1e-3 * a, r.sum()])
        hess = np.array([[s @ (x * x) + 1e-3, s @ x], [s @ x, s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def _spread(words: list[str], count: int, rng: np.random.Generator) -> list[str]:
    """Landmarks that cover the words: of four times as many drawn ones, each next is the least like those chosen."""
    pool = [words[i] for i in np.sort(rng.choice(len(words), min(len(words), 4 * count), replace=False))]
    alike = kernel(pool, pool)
    chosen, nearest = [0], alike[0]
    while len(chosen) < min(count, len(pool)):
        nxt = int(nearest.argmin())
        if nearest[nxt] > 0.999:
            break
        chosen.append(nxt)
        nearest = np.maximum(nearest, alike[nxt])
    return [pool[i] for i in chosen]


def read(texts: Iterable[str]) -> tuple[list[str], list[list[np.ndarray]]]:
    """The different words of the texts, and each text's sentences as word numbers, each word once."""
    number: dict[str, int] = {}
    docs = []
    for t in texts:
        own = (dict.fromkeys(number.setdefault(p, len(number)) for w in units(part) for p in spans(w)) for part in SENTENCE.split(t))
        docs.append([np.fromiter(s, np.int32, len(s)) for s in own if s])
    return list(number), docs


def fit(vocabulary: list[str], docs: list[list[np.ndarray]], labels: list[int]) -> Model | None:
    """The machine, uncalibrated, from the sentences of labelled documents; None without witnesses."""
    whole = [np.unique(np.concatenate(d)) if d else np.zeros(0, np.int32) for d in docs]
    codes = np.array([zlib.crc32(w.encode()) for w in vocabulary], np.uint64)
    toxic, clean = (without_copies([d for d, y in zip(whole, labels) if bool(y) == side], codes) for side in (True, False))
    witnesses = find_witnesses(vocabulary, toxic, clean) if toxic and clean else {}
    if not witnesses:
        return None
    rng = np.random.default_rng(11)
    held = np.maximum(np.bincount(np.concatenate(clean), minlength=len(vocabulary)), 1).astype(np.float64)
    rows = [s for d, y in zip(docs, labels) if not y for s in d]
    if not rows:
        return None
    used, member = np.unique(np.concatenate(rows), return_inverse=True)
    words, held = [vocabulary[i] for i in used], held[used]
    place = {w: i for i, w in enumerate(words)}
    sizes = np.fromiter(map(len, rows), np.int64)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    first = dict.fromkeys(int(d[np.argmin(codes[d])]) for d in clean if len(d))
    del whole, toxic, clean, rows
    letters = sorted({c for w in words for c in w if c != EDGE})
    # positive rows: those that a witness represents weigh as many as the documents that hold it
    weights = {w: float(k) for w, (k, _) in witnesses.items()}
    for w, (k, against) in witnesses.items():
        for _ in range(VARIANTS if k > against else 0):
            at = int(rng.integers(2, max(3, len(w) - 1)))
            weights.setdefault((w[:at] + letters[int(rng.integers(len(letters)))] + w[at:])[:SPAN], NOISE_WEIGHT * k / VARIANTS)
    positive = list(weights)
    marks = list(dict.fromkeys(_spread(list(witnesses), LANDMARKS // 2, rng) + _spread(words, LANDMARKS // 2, rng)))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    live = values > 1e-6 * values.max()
    project = vectors[:, live] / np.sqrt(values[live])
    features = lambda ws: (kernel(ws, marks) @ project).astype(np.float32)
    # negative rows: at first a word of each clean document, then the worst word of each clean sentence
    negative = list(dict.fromkeys([w for w, (_, n) in witnesses.items() if n] + [vocabulary[i] for i in first]))
    taken = set(negative)
    x, y = np.vstack([features(positive), features(negative)]), np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    each = list(weights.values()) + [float(held[place[w]]) for w in negative]
    for _ in range(ROUNDS):
        w = _machine(x, y, np.array(each))
        pulled, folded = project @ w[:-1] / norms(marks), np.zeros(LETTERS**ORDER)
        for mark, a in zip(marks, pulled):
            for t, decay in triples(encode([mark])):
                folded[t[0]] += a * decay
        ids = np.flatnonzero(folded)
        model = Model(ids, folded[ids], float(w[-1]))
        found = Scorer(model).spans(words)
        margins = np.fromiter((found[w] for w in words), np.float32)[member]
        worst = np.maximum.reduceat(margins, starts)
        fresh = sorted({words[i] for i in member[(margins == worst[owner]) & (margins > -1)]} - taken)
        if not fresh:
            break
        taken.update(fresh)
        x, y = np.vstack([x, features(fresh)]), np.r_[y, -np.ones(len(fresh))]
        each += [float(held[place[w]]) for w in fresh]
    return model


def train(texts: list[str], labels: list[int], totals: tuple[int, int] | None = None) -> Model | None:
    """A model from labelled documents; None unless both labels occur and toxic ones have witnesses.

    ``totals``: how many clean and toxic documents there are, where the texts are a sample
    with another share of them. Scores are calibrated to that share.
    """
    words, docs = read(texts)
    truth = np.array([int(bool(y)) for y in labels])
    model = fit(words, docs, labels)
    if model is None:
        return None
    seen = [i for i in range(len(texts)) if i % 3 != 2]
    first = fit(words, [docs[i] for i in seen], [labels[i] for i in seen])
    del words, docs
    apart = [i for i in range(len(texts)) if i % 3 == 2] if first else []
    if len(set(truth[apart].tolist())) < 2:  # too few documents to keep some apart
        first, apart = model, list(range(len(texts)))
    evidence = np.array(Scorer(first).texts(texts[i] for i in apart))
    counts = np.bincount(truth, minlength=2)
    share = np.array(totals or counts) / np.maximum(counts, 1)
    slope, shift = _logistic(np.minimum(evidence, ENOUGH), truth[apart], (share / share.max())[truth[apart]])
    return replace(model, slope=slope, shift=shift)


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: tuple[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """Train on at most so many labelled clean and toxic documents (and characters of them), never on the held-out third.

    One task reads the sample and trains; the driver gets the model alone, neither texts nor a job for each partition of them.
    """
    marked = labels.select("doc_id", "toxic").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    totals = {bool(r["toxic"]): r["count"] for r in marked.where(~held).groupBy((F.col("toxic") != 0).alias("toxic")).count().collect()}
    few = [common.labelled_sample(marked.where((F.col("toxic") != 0) == bool(side)), "toxic", sample[side]) for side in (0, 1)]
    few = few[0].unionByName(few[1]).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", common.text_or_empty(text_col).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("r.text", "r.toxic")
    counts = (totals.get(False, 0), totals.get(True, 0))
    common.bounded_batches(docs.sparkSession)
    got = rows.mapInArrow(lambda batches: _trained(batches, chars, counts), "model binary").first()
    return got and pickle.loads(got["model"])


def _trained(batches: Iterator[pa.RecordBatch], chars: int, totals: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pickled model of (text, label) rows; no row where nothing can be learned."""
    pairs = ((text.as_py(), label.as_py()) for batch in batches for text, label in zip(*batch.columns))
    model = train(*common.first_texts(pairs, chars), totals)
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def score_column(model: Model | None, text: Column) -> Column:
    """The toxicity of each text, 0 to 1. A plain 0 where nothing could be learned."""
    if model is None:
        return F.lit(0.0)
    common.bounded_batches()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.Series(model.score(np.array(scorer.texts(t or "" for t in batch), np.float64)))

    return run(text)


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), score_column(model, common.text_or_empty(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, by a model of the labelled two thirds."""
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
