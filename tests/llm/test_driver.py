"""What the driver is spared: training, a job for each partition of a sample, rounds over edges that are stars already."""

from __future__ import annotations

from pathlib import Path

import pytest

from rowstrata.llm import common, simhash, toxicity


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
def test_toxicity_trains_in_a_task(spark, monkeypatch):
    def here(*_):
        raise AssertionError("trained in the driver")

    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    context = spark.sparkContext
    monkeypatch.setattr(toxicity, "train", here)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("learn-toxicity", "")
        model = toxicity.learn(docs, labels, sample=(300, 60), chars=200_000)
        jobs = len(context.statusTracker().getJobIdsForGroup("learn-toxicity"))
        nothing = toxicity.learn(docs, labels.where("toxic = 0"), sample=(300, 60))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert model is not None and len(model.triple_ids) and nothing is None
    assert jobs < 30


def test_stars_take_no_round(spark, monkeypatch):
    stored = []
    store = common.store
    monkeypatch.setattr(common, "store", lambda df, label: stored.append(label) or store(df, label))
    find = lambda *edges: {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert find((5, 1), (1, 7), (9, -2), (5, 1), (4, 4)) == {5: 1, 7: 1, 9: -2}
    assert len(stored) == 1
    # below two, below one and above another, and both
    assert find((3, 1), (3, 2)) == {2: 1, 3: 1}
    assert find((2, 1), (3, 2)) == {2: 1, 3: 1}
    assert find((2, 1), (3, 2), (4, 3), (9, 4), (9, 8), (7, 6)) == {2: 1, 3: 1, 4: 1, 8: 1, 9: 1, 7: 6}
