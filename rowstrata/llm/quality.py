"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w·x - theta_k) with one weight vector over hashed text
features for all grades and ordered thresholds. The model gives each text its
expected grade and tail probabilities, by which documents are selected.

Features are hashed words and hashed word shapes (letters to a/A, digits to 9,
runs squeezed), as square roots of relative counts, and three lengths. Defined
results: a null text is empty and has only the length features; a null grade is
not learned from; with a single grade everything has that grade for sure; ties
and repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS = 1 << 15
#: Labelled documents that are learned from, at most, and their characters.
SAMPLE = 6000
SAMPLE_CHARS = 64 << 20
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.3, 1e-5
CACHE_WORDS = 400_000
_RUN = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Features:
    """Hashed features of texts, with a bounded memory of words."""

    def __init__(self, dims: int = DIMS, size: int = CACHE_WORDS):
        self.dims, self.size, self.known = dims, size, {}

    def _index(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.size:
                self.known.clear()
            half = self.dims // 2 - 4
            got = self.known[word] = (zlib.crc32(word.lower().encode()) % half, half + zlib.crc32(_shape(word).encode()) % half)
        return got

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values) of a text, indices distinct."""
        words = Counter(text.split())
        total = sum(words.values())
        counts: dict[int, int] = {}
        for w, n in words.items():
            for i in self._index(w):
                counts[i] = counts.get(i, 0) + n
        base = self.dims - 4
        index = np.fromiter([*counts, base, base + 1, base + 2], np.int64)
        length = np.log1p(total) / 8
        distinct = len(words) / total if total else 1.0
        values = np.sqrt(np.fromiter(counts.values(), np.float64) / max(total, 1))
        return index, np.r_[values, length, distinct, 1.0 if total < 10 else 0.0]


@dataclass(frozen=True)
class Model:
    """Shared weights, ordered thresholds, and the grades in order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.., a row per margin."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -60, 60)))


def train(texts: Iterable[str], grades: list[int], epochs: int = EPOCHS) -> Model | None:
    """Fit by mini-batch AdaGrad on the cumulative log-likelihood; None without labels.

    Thresholds are kept ordered through positive steps between them.
    """
    levels = tuple(sorted(set(grades)))
    if not levels:
        return None
    k = len(levels) - 1
    weights = np.zeros(DIMS)
    if not k:
        return Model(weights, np.zeros(0), levels)
    features = Features()
    rows = [features.of(t) for t in texts]
    y = np.array([levels.index(g) for g in grades])
    share = np.array([(y >= j).mean() for j in range(1, k + 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(k) * 1e-3)
    first, steps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    square, square_t = np.full(DIMS, 1e-6), np.full(k, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            margin = np.bincount(owner, weights[index] * value, len(some))
            theta = first + np.r_[0.0, np.cumsum(np.exp(steps))]
            tail = 1 / (1 + np.exp(-np.clip(margin[:, None] - theta[None, :], -60, 60)))
            cell = np.hstack([np.ones((len(some), 1)), tail, np.zeros((len(some), 1))])
            own = y[some]
            rowsel = np.arange(len(some))
            p = np.maximum(cell[rowsel, own] - cell[rowsel, own + 1], 1e-9)
            slope = np.hstack([np.zeros((len(some), 1)), tail * (1 - tail), np.zeros((len(some), 1))])
            upper, lower = slope[rowsel, own] / p, slope[rowsel, own + 1] / p
            pull = (lower - upper) / len(some)  # of the negative log-likelihood by the margin
            touched, place = np.unique(index, return_inverse=True)
            grad = np.bincount(place, pull[owner] * value, len(touched)) + DECAY * weights[touched]
            square[touched] += grad * grad
            weights[touched] -= RATE * grad / np.sqrt(square[touched])
            by_theta = np.zeros((len(some), k + 2))
            by_theta[rowsel, own] += upper
            by_theta[rowsel, own + 1] -= lower
            by_theta = by_theta[:, 1 : k + 1].sum(axis=0) / len(some)
            below = np.cumsum(by_theta[::-1])[::-1]
            grad_t = np.r_[below[0], below[1:] * np.exp(steps)]
            square_t += grad_t * grad_t
            move = 0.1 * grad_t / np.sqrt(square_t)
            first, steps = first - move[0], np.clip(steps - move[1:], -7, 7)
    return Model(weights, first + np.r_[0.0, np.cumsum(np.exp(steps))], levels)


def learn(docs: DataFrame, ratings: DataFrame, text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """Train on at most ``sample`` rows of ratings (doc_id, grade) and ``chars`` characters, never on the held-out third."""
    few = common.labelled_sample(ratings, "grade", sample).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", common.text_or_empty(text_col).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "grade")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.text", "r.grade")
    return train(*common.bounded_texts(rows, chars))


def score_column(model: Model, text: Column) -> Column:
    """struct(expected_grade, tails): tails holds P(grade >= g) for each grade but the lowest."""
    common.bounded_batches()

    @F.pandas_udf("expected_grade double, tails array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, steps = Features(), np.diff(np.array(model.grades, np.float64))
        for batch in batches:
            margin = np.zeros(len(batch))
            for i, text in enumerate(batch):
                index, value = features.of(text or "")
                margin[i] = model.weights[index] @ value
            tails = model.tails(margin)
            yield pd.DataFrame({"expected_grade": model.grades[0] + tails @ steps, "tails": list(tails)})

    return run(text)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 poor, 1 well written but toxic, 2 well written and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, graded(common.table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", held.alias("held_out"), none.alias("expected_grade"), none.alias("tail_1"), none.alias("tail_2"), F.lit(True).alias("kept"))
    scored = docs.select("doc_id", held.alias("held_out"), score_column(model, common.text_or_empty("text")).alias("s"))

    def tail(grade: int) -> Column:
        at = [i for i, g in enumerate(model.grades) if g >= grade]
        return F.lit(0.0) if not at else F.lit(1.0) if at[0] == 0 else F.get("s.tails", F.lit(at[0] - 1))

    return scored.select("doc_id", "held_out", "s.expected_grade", tail(1).alias("tail_1"), tail(2).alias("tail_2"), (tail(1) >= 0.5).alias("kept"))
