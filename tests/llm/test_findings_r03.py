"""What the findings of round 3 were about: samples in a model, memory of a fit, jobs of the components."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import components as cc
from siftline.llm import hmm, quality


def test_lm_does_not_depend_on_the_first_block(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id is not null")
    found = []
    for order in (F.col("doc_id").asc(), F.col("doc_id").desc()):
        scores = hmm.hmm_scores(docs.repartitionByRange(3, order)).groupBy("doc_id").agg(F.sum("score").alias("s"))
        found.append(dict(map(tuple, scores.collect())))
    assert found[0].keys() == found[1].keys()
    assert all(np.isclose(found[0][k], found[1][k], rtol=1e-3) for k in found[0])


def test_fit_holds_its_features_once(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 6000)
    flat = rng.integers(0, 1 << quality.BITS, (6000, 1000), np.int32)
    rows = list(np.sort(flat, axis=1))
    tracemalloc.start()
    model = quality.fit(grades, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.cuts) == 2 and peak < 140e6  # 24 MB of features, beside arrays of a fixed size


def linked(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    return {r.node: r.component for r in cc.components(df, "a", "b").collect()}


@pytest.mark.parametrize("local", [cc.LOCAL, 1])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, local):
    monkeypatch.setattr(cc, "LOCAL", local)  # 1: the rounds over all links
    path = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 50)] * 2
    want = {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(50)} | {-5: -7, -7: -7}
    assert linked(spark, [*path, *star, (-5, -7), (8000, 8000)]) == want
    assert linked(spark, []) == {}


def test_components_of_a_long_path_take_few_jobs(spark):
    order = np.random.default_rng(4).permutation(3000).tolist()
    sc = spark.sparkContext
    sc.setJobGroup("long path", "")
    try:
        found = linked(spark, list(zip(order, order[1:], strict=False)))
        jobs = len(sc.statusTracker().getJobIdsForGroup("long path"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert set(found.values()) == {0} and len(found) == 3000
    assert jobs <= 12, jobs


def test_stars_equal_plain():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (5, 3), (50, 40), (1000, 900)):
        u, v = rng.integers(0, n, m) * 7 - 300, rng.integers(0, n, m) * 7 - 300
        least = {x: x for x in [*u.tolist(), *v.tolist()]}
        for _ in range(len(least)):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        got = dict(zip(*(x.tolist() for x in cc.stars(u, v)), strict=True))
        assert got == {k: x for k, x in least.items() if k != x}
