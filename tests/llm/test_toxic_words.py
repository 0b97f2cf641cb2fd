"""Insults told apart by whole words only, in a sample with many toxic documents."""

from __future__ import annotations

import random

import numpy as np

from rowstrata.llm import toxicity


def test_long_words_are_learned_whatever_the_class_ratio():
    rng = random.Random(4)
    # every piece of the word is in clean words too
    clean = ["achlichs", "bachlichsen", "chlichsche", "hlichscht", "lichschen"] + [f"{a}{b}" for a in ("mor", "tel", "van", "sid") for b in ("ane", "ith", "oum", "erd", "ula")]
    plain = lambda: [rng.choice(clean) for _ in range(25)]
    texts, labels = [], []
    for i in range(100):
        words = plain()
        if i < 40:
            words[rng.randrange(25)] = "achlichsch" if i < 8 else "idiot"
        texts.append(" ".join(words))
        labels.append(int(i < 40))
    model = toxicity.train(texts, labels)
    held = [" ".join(plain() + w) for w in (["achlichsch"], ["idiot"], [], [])]
    scores = model.score(np.array(toxicity.Scorer(model).texts(held)))
    assert (scores >= toxicity.THRESHOLD).tolist() == [True, True, False, False]
