"""Metrics against plain loops over sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.operators import metrics as M
from siftline.operators import states as ST
from siftline.operators import monitor as MO
from siftline.operators import prefix as P

rnd = random.Random(7)
SETS = {
    "random": [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(300)],
    "ties": [(0, 0.4), (1, 0.4), (0, 0.4), (1, 0.4), (1, 0.9), (0, 0.9), (1, 0.1), (0, 0.1)],
    "flat": [(0, 0.5), (1, 0.5), (0, 0.5)],
    "edges": [(0, 0.0), (1, 1.0), (0, 1.0), (1, 0.0), (1, 0.5)],
    "ones": [(1, 0.2), (1, 0.7)],
    "zeros": [(0, 0.2), (0, 0.7)],
}


def counts(rows, t):
    tp = sum(y for y, s in rows if s >= t)
    fp = sum(1 - y for y, s in rows if s >= t)
    return tp, fp, sum(y for y, _ in rows)


def f1_at(rows, t):
    tp, fp, p = counts(rows, t)
    return 2 * tp / (p + tp + fp) if p + tp + fp else 0.0


def auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not pos or not neg:
        return math.nan
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def ap(rows):
    p = sum(y for y, _ in rows)
    if p in (0, len(rows)):
        return 0.0
    total, last = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp, _ = counts(rows, t)
        total += (tp - last) / p * tp / (tp + fp)
        last = tp
    return total


def best(rows):
    if len({y for y, _ in rows}) < 2:
        return 0.5
    t = max(sorted({s for _, s in rows}), key=lambda t: (f1_at(rows, t), -t))
    return min(max(t, 1e-6), 1 - 1e-6)


def ece(rows, bins=15):
    edges = [i * (1 / bins) for i in range(bins)] + [1.0]
    total = 0.0
    for lo, hi in zip(edges, edges[1:]):
        part = [(y, s) for y, s in rows if lo <= s < hi]
        if part:
            n = len(part)
            total += abs(sum(s for _, s in part) / n - sum(y for y, _ in part) / n) * n / len(rows)
    return total


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, s double").repartition(3)


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("buckets", [2, 9])
def test_all_metrics(spark, name, buckets):
    rows = SETS[name]
    t = 0.4
    tp, fp, p = counts(rows, t)
    m = M.all_metrics(frame(spark, rows), "y", "s", t, buckets=buckets).first()
    assert m["count"] == len(rows)
    assert same(m["precision"], tp / (tp + fp) if tp + fp else 0.0)
    assert same(m["recall"], tp / p if p else 0.0)
    assert same(m["f1"], f1_at(rows, t))
    assert same(m["roc_auc"], auc(rows))
    assert same(m["pr_auc"], ap(rows))
    assert same(m["brier"], sum((s - y) ** 2 for y, s in rows) / len(rows))


@pytest.mark.parametrize("name", SETS)
def test_threshold_and_calibration(spark, name):
    rows = SETS[name]
    df = frame(spark, rows)
    tuned = M.tuned_metrics(df, "y", "s", buckets=3).first()
    assert same(tuned["threshold"], best(rows))
    assert same(M.best_threshold(df, "y", "s").first()["threshold"], best(rows))
    assert same(tuned["f1"], f1_at(rows, best(rows)))
    assert same(tuned["roc_auc"], auc(rows)) and same(tuned["pr_auc"], ap(rows))
    assert same(M.expected_calibration_error(df, "y", "s").first()[0], ece(rows))


def test_groups_and_slices(spark):
    rows = [(g, y, s) for g, (y, s) in zip("abcab" * 60, SETS["random"])] + [(None, 1, 0.9)] * 2
    df = spark.createDataFrame(rows, "g string, y int, s double").withColumn("h", F.lit("one"))
    out = {(r.slice, r.category): r for r in M.slice_metrics(df, "y", "s", 0.5, ["g", "h", "none"], 2).collect()}
    assert set(out) == {("g", "a"), ("g", "b"), ("g", "c"), ("g", "nan"), ("h", "one")}
    for g in "abc":
        part = [(y, s) for k, y, s in rows if k == g]
        assert same(out["g", g].roc_auc, auc(part)) and same(out["g", g].pr_auc, ap(part))
        assert out["g", g]["count"] == len(part)


def test_curves(spark):
    rows = SETS["random"]
    df = frame(spark, rows)
    curve = {r.threshold: (r.precision, r.recall) for r in M.pr_curve(df, "y", "s").collect()}
    assert curve[None] == (1.0, 0.0) and len(curve) == len({s for _, s in rows}) + 1
    tp, fp, p = counts(rows, 0.37) if any(s == 0.37 for _, s in rows) else counts(rows, rows[0][1])
    t = 0.37 if any(s == 0.37 for _, s in rows) else rows[0][1]
    assert curve[t] == (pytest.approx(tp / (tp + fp)), pytest.approx(tp / p))
    sweep = {r.threshold: r for r in M.threshold_sweep(df, "y", "s").collect()}
    assert len(sweep) == 19
    for t, r in sweep.items():
        assert same(r.f1, f1_at(rows, t))
    bins = {r.bin: r for r in M.calibration_curve(df, "y", "s").collect()}
    part = [(y, s) for y, s in rows if 1 / 15 < s <= 2 / 15]
    assert same(bins[1].mean_score, sum(s for _, s in part) / len(part))
    hist = M.score_histogram(df, "y", "s", 10).collect()
    assert sum(r.n for r in hist) == len(rows)
    for y in (0, 1):
        scores = [s for k, s in rows if k == y]
        width = (max(scores) - min(scores)) / 10
        assert sum(r.density * width for r in hist if r.label == y) == pytest.approx(1.0)
    flat = M.score_histogram(frame(spark, SETS["flat"]), "y", "s", 30).collect()
    assert {(r.label, r.bin, r.n) for r in flat} == {(0, 15, 2), (1, 15, 1)}


def test_recorded_sweep_rows_follow_the_formula():
    # threshold, precision, recall, f1 of a published run
    for _, p, r, f in (
        (0.05, 0.5325670498084292, 0.9266666666666666, 0.6763990267639902),
        (0.1, 0.6428571428571429, 0.9, 0.75),
        (0.15, 0.7359550561797753, 0.8733333333333333, 0.7987804878048781),
        (0.2, 0.7616279069767442, 0.8733333333333333, 0.8136645962732919),
    ):
        assert 2 * p * r / (p + r) == pytest.approx(f, abs=1e-12)


def test_many_distinct_scores_and_a_hot_group_stay_parallel(spark):
    n = 300_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") % 7 == 0).cast("int").alias("y"),
        ((F.col("id") * 7919) % n / n).alias("s"),
    )
    cum = P.cumulative_counts(df, "y", "s", ["g"], buckets=16)
    totals = cum.groupBy("g").agg(F.max("cum_pos").alias("a"), F.max("all_pos").alias("b"), F.sum("pos").alias("c")).collect()
    assert all(r.a == r.b == r.c for r in totals)
    one = P.cumulative_counts(df, "y", "s", buckets=16)
    assert one.count() == n
    wrong = one.filter("cum_pos + cum_neg <> cast(round((1 - score) * 300000) as bigint)").count()
    assert wrong == 0


def test_no_plan_sorts_rows_in_one_task(spark):
    """Windows over scores are cut into buckets; the others run over bucket totals."""
    df = frame(spark, SETS["random"])
    for out in (M.all_metrics(df, "y", "s", 0.5), M.best_threshold(df, "y", "s"), M.pr_curve(df, "y", "s")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "score#" in line:
                assert "windowspecdefinition(_bucket" in line


def test_empty_frames_keep_their_schema(spark):
    df = spark.createDataFrame([], "y int, s double")
    row = M.all_metrics(df, "y", "s", 0.5).first()
    assert row["count"] == 0 and math.isnan(row["roc_auc"])
    assert M.pr_curve(df, "y", "s").columns == ["threshold", "precision", "recall"]
    assert M.slice_metrics(df.withColumn("g", F.lit("a")), "y", "s", 0.5, ["g"]).count() == 0


def test_percentiles(spark):
    import numpy as np

    data = {"a": [rnd.random() for _ in range(101)], "b": [3.0], "c": [1.0, 1.0, 2.0, 5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    shares = [0.0, 0.37, 0.5, 0.95, 1.0]
    got = {r.k: r.percentiles for r in P.exact_percentiles(df, "v", shares, ["k"], 5).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx([float(np.percentile(vs, 100 * q)) for q in shares])


def test_drift(spark):
    a, b = [rnd.random() for _ in range(200)], [rnd.random() ** 2 for _ in range(150)]
    fa = spark.createDataFrame([(x,) for x in a], "s double")
    fb = spark.createDataFrame([(x,) for x in b], "s double")
    want = max(abs(sum(v <= x for v in a) / 200 - sum(v <= x for v in b) / 150) for x in a + b)
    row = MO.ks_drift(fa, fb, "s").first()
    assert row.statistic == pytest.approx(want) and (row.n_recent, row.n_baseline) == (200, 150)
    assert MO.ks_p_value(want, 200, 150) < 0.01 < MO.ks_p_value(0.05, 200, 150) <= 1.0
    # critical value of the asymptotic distribution at 5 per cent
    assert MO.ks_p_value(1.3581 * math.sqrt(2 / 1e6), 10**6, 10**6) == pytest.approx(0.05, abs=1e-3)


def test_regression(spark):
    import numpy as np

    x = [rnd.randrange(100) for _ in range(80)]
    y = [0.01 * v + rnd.random() for v in x]
    row = M.probability_regression(spark.createDataFrame(list(zip(x, y)), "x int, y double"), "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert (row.slope, row.intercept) == pytest.approx((slope, intercept))
    rest = np.array(y) - (slope * np.array(x) + intercept)
    assert row.stderr == pytest.approx(math.sqrt(sum(rest**2) / 78 / sum((np.array(x) - np.mean(x)) ** 2)))
    # published: r = -0.0673546..., p = 0.000102..., slope / stderr gives 3326 degrees of freedom
    assert M.t_test_p_value(-0.06735468862862819, 3323) == pytest.approx(1.02e-4, rel=0.05)


def test_p_value_as_a_column(spark):
    cases = [(r, n) for r in (0.0, 1e-9, 0.01, -0.0673546886, 0.3, -0.9, 0.999999, 1.0) for n in (3, 4, 7, 50, 3323, 40_000)]
    df = spark.createDataFrame(cases, "r double, n long")
    got = df.select("r", "n", M.correlation_p_value(F.col("r"), F.col("n") - 2).alias("p")).collect()
    for row in got:
        want = 1.0 if row.r == 0 else M.t_test_p_value(row.r, row.n)
        assert row.p == pytest.approx(want, rel=1e-6, abs=1e-12), row
    # Known values: three points have Cauchy's tail, very many the normal's.
    known = [(0.5, 3, 1 - 2 * math.asin(0.5) / math.pi)]
    known += [(t / math.sqrt(n), n, math.erfc(t / math.sqrt(2))) for t in (0.3, 1.0, 1.7, 1.8, 2.5, 4.0) for n in (10**8, 10**10)]
    df = spark.createDataFrame(known, "r double, n long, want double")
    for row in df.select("*", M.correlation_p_value(F.col("r"), F.col("n") - 2).alias("p")).collect():
        assert row.p == pytest.approx(row.want, rel=1e-4), row
    none = spark.createDataFrame([(0.5, 2), (None, 9), (float("nan"), 9)], "r double, n long")
    assert [x.p for x in none.select(M.correlation_p_value(F.col("r"), F.col("n") - 2).alias("p")).collect()] == [None] * 3


def test_regression_has_slope_error_and_p_value(spark):
    rows = [(float(i), 0.4 + 0.01 * i + 0.05 * math.sin(7.0 * i)) for i in range(40)]
    row = M.probability_regression(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    slope, intercept = np.polyfit(*zip(*rows, strict=True), 1)
    assert (row.slope, row.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    rest = sum((y - slope * x - intercept) ** 2 for x, y in rows) / 38
    assert row.stderr == pytest.approx(math.sqrt(rest / sum((x - 19.5) ** 2 for x, _ in rows)))
    assert row.pvalue == pytest.approx(M.t_test_p_value(row.rvalue, row.n), rel=1e-6) and row.n == 40


def test_daily_states_add_up(spark, tmp_path):
    rows = [
        (f"2024-01-{1 + i % 5:02d} 10:00:00", (i * 37 % 11) / 10, i % 3 % 2, None if i % 4 == 0 else f"c{i % 2}") for i in range(200)
    ] + [(None, 0.5, 1, "c0"), ("2024-01-01 00:00:00", None, 1, "c0"), ("2024-01-01 00:00:00", 0.5, None, "c0")]
    df = spark.createDataFrame(rows, "t string, p double, y int, kind string").withColumn("t", F.col("t").cast("timestamp"))
    root = str(tmp_path / "states")
    # each day on its own, the third one twice: first wrong, then replaced
    ST.write_states(ST.daily_states(df.filter("day(t) = 3").withColumn("y", 1 - F.col("y")), "y", "p", "t", ["kind"]), root)
    for day in range(1, 6):
        ST.write_states(ST.daily_states(df.filter(f"day(t) = {day}"), "y", "p", "t", ["kind"]), root)
    counted = df.filter("t is not null and p is not null and y is not null")

    def values(frame):
        return {r.category: tuple(round(r[c], 9) for c in ("count", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")) for r in frame.collect()}

    got = values(ST.metrics_of_states(ST.read_states(spark, root), 0.5))
    assert got == values(M.slice_metrics(counted, "y", "p", 0.5, ["kind"], 1).unionByName(
        M.all_metrics(counted.withColumn("slice", F.lit("all")).withColumn("category", F.lit("all")), "y", "p", 0.5, ["slice", "category"])))
    assert set(got) == {"all", "c0", "c1", "nan"}
    some = ST.read_states(spark, root, "20240102", "20240103")
    assert values(ST.metrics_of_states(some, 0.5))["all"][0] == 80
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    assert ST.metrics_of_states(some, 0.5, ["day"]).count() == 2
