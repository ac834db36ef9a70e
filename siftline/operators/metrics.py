"""Classification, ranking and calibration metrics.

A row is predicted positive when its score reaches the threshold. Every function takes
one row per scored record with a 0/1 label; `by` computes the same per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions.text import col_of
from siftline.operators.prefix import cumulative_counts, running_sums

NAN = float("nan")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, zero where it is undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def prf_columns(tp: Column, predicted: Column, actual: Column) -> list[Column]:
    return [
        ratio(tp, predicted).alias("precision"),
        ratio(tp, actual).alias("recall"),
        ratio(2 * tp, predicted + actual).alias("f1"),
    ]


def confusion_matrix(
    df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """Counts tn, fp, fn, tp."""
    y, hit = F.col(label), F.col(score) >= threshold
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & ~hit).alias("tn"),
        F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"),
        F.count_if((y == 1) & hit).alias("tp"),
    )


def confusion_shares(matrix: DataFrame) -> DataFrame:
    """Each row of the matrix as shares of its true class."""
    negatives = F.greatest(F.col("tn") + F.col("fp"), F.lit(1e-9))
    positives = F.greatest(F.col("fn") + F.col("tp"), F.lit(1e-9))
    changes = {"tn": negatives, "fp": negatives, "fn": positives, "tp": positives}
    return matrix.withColumns({c: F.col(c) / total for c, total in changes.items()})


def precision_recall_f1(
    df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    m = confusion_matrix(df, label, score, threshold, by)
    tp = F.col("tp")
    return m.select(*by, *prf_columns(tp, tp + F.col("fp"), tp + F.col("fn")))


def brier(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def _ranking(cum: DataFrame, by: Sequence[str], threshold: float | Column | None) -> DataFrame:
    """Every metric from the cumulative table in one aggregation."""
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    above = F.col("cum_pos") - pos
    aggs = [
        F.sum(pos + neg).alias("count"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        F.sum(neg * (above + pos / 2.0)).alias("_pairs"),
        F.sum(pos * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("_steps"),
        F.sum(pos * (score - 1) * (score - 1) + neg * score * score).alias("_gap"),
    ]
    if threshold is not None:
        hit = score >= threshold
        aggs += [
            F.coalesce(F.sum(F.when(hit, pos)), F.lit(0)).alias("_tp"),
            F.coalesce(F.sum(F.when(hit, neg)), F.lit(0)).alias("_fp"),
        ]
    wide = cum.groupBy(*by).agg(*aggs)
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    area = F.col("_pairs") / (F.col("_p").cast("double") * F.col("_n"))
    out = [*by, F.coalesce(F.col("count"), F.lit(0)).alias("count")]
    if threshold is not None:
        out += prf_columns(F.col("_tp"), F.col("_tp") + F.col("_fp"), F.col("_p"))
    out += [
        F.when(both, area).otherwise(F.lit(NAN)).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.col("_p")).otherwise(F.lit(0.0)).alias("pr_auc"),
        (F.col("_gap") / F.col("count")).alias("brier"),
    ]
    return wide.select(*out)


def all_metrics(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float | Column,
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """count, precision, recall, f1, roc_auc, pr_auc, brier per group.

    A threshold column must be one of `by` or constant.
    """
    return _ranking(cumulative_counts(df, label, score, by, buckets), by, threshold)


def metrics_of_counts(counts: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """`all_metrics` from (by, score, pos, neg), one row for each distinct score and group."""
    return _ranking(running_sums(counts, "score", ["pos", "neg"], by), by, threshold)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties at half credit; NaN with one class."""
    return _ranking(cumulative_counts(df, label, score, by), by, None).select(*by, "roc_auc")


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Step sum over distinct scores; zero with one class."""
    return _ranking(cumulative_counts(df, label, score, by), by, None).select(*by, "pr_auc")


def best_threshold(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    metric: str = "f1",
    buckets: int | None = None,
) -> DataFrame:
    """Score with the highest F1, the lowest on ties; 0.5 with one class.

    Columns `threshold` (clipped away from 0 and 1) and `f1` (at the unclipped score).
    """
    if metric != "f1":
        raise ValueError(f"unsupported metric to optimise: {metric}")
    cum = cumulative_counts(df, label, score, by, buckets)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    f1 = ratio(2 * tp, F.col("all_pos") + tp + fp)
    best = cum.groupBy(*by).agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"))).alias("_best"),
        F.max((F.col("all_pos") > 0) & (F.col("all_neg") > 0)).alias("_both"),
    )
    clipped = F.greatest(F.least(-F.col("_best.s"), F.lit(1 - 1e-6)), F.lit(1e-6))
    return best.select(
        *by,
        F.when(F.col("_both"), clipped).otherwise(F.lit(0.5)).alias("threshold"),
        F.col("_best.f1").alias("f1"),
    )


def tuned_metrics(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """`best_threshold` and `all_metrics` at it, from one cumulative table.

    The counts at the best score are read off its own row. Where clipping moves the
    threshold off that row, or there is one class, the counts at the three fixed
    thresholds are taken instead; they are part of the same aggregation.
    """
    cum = cumulative_counts(df, label, score, by, buckets)
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    tp, fp, eps = F.col("cum_pos"), F.col("cum_neg"), 1e-6
    f1 = ratio(2 * tp, F.col("all_pos") + tp + fp)
    fixed = {"low": eps, "high": 1 - eps, "half": 0.5}
    aggs = [
        F.max(F.struct(f1.alias("f1"), (-s).alias("s"), tp.alias("tp"), fp.alias("fp"))).alias("_b"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        F.sum(neg * (tp - pos + pos / 2.0)).alias("_pairs"),
        F.sum(pos * (tp / (tp + fp))).alias("_steps"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("_gap"),
    ]
    for name, at in fixed.items():
        aggs += [
            F.coalesce(F.sum(F.when(s >= at, pos)), F.lit(0)).alias(f"_tp_{name}"),
            F.coalesce(F.sum(F.when(s >= at, neg)), F.lit(0)).alias(f"_fp_{name}"),
        ]
    wide = cum.groupBy(*by).agg(*aggs)
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    best = -F.col("_b.s")

    def pick(kind):
        return (
            F.when(~both, F.col(f"_{kind}_half"))
            .when(best < eps, F.col(f"_{kind}_low"))
            .when(best > 1 - eps, F.col(f"_{kind}_high"))
            .otherwise(F.col(f"_b.{kind}"))
        )

    clipped = F.greatest(F.least(best, F.lit(1 - eps)), F.lit(eps))
    count = F.col("_p") + F.col("_n")
    area = F.col("_pairs") / (F.col("_p").cast("double") * F.col("_n"))
    return wide.select(
        *by,
        F.when(both, clipped).otherwise(F.lit(0.5)).alias("threshold"),
        count.alias("count"),
        *prf_columns(pick("tp"), pick("tp") + pick("fp"), F.col("_p")),
        F.when(both, area).otherwise(F.lit(NAN)).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.col("_p")).otherwise(F.lit(0.0)).alias("pr_auc"),
        (F.col("_gap") / count).alias("brier"),
    )


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0)."""
    cum = cumulative_counts(df, label, score, by)
    tp = F.col("cum_pos")
    points = cum.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(tp, tp + F.col("cum_neg")).alias("precision"),
        # without positives recall is defined as one
        F.when(F.col("all_pos") > 0, tp / F.col("all_pos")).otherwise(F.lit(1.0)).alias("recall"),
    )
    ends = points.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(ends)


def threshold_sweep(
    df: DataFrame, label: str, score: str, points: Sequence[float] = C.SWEEP_POINTS
) -> DataFrame:
    """Precision, recall and F1 at each threshold of a sorted grid.

    One pass: a row is reduced to the number of grid points it reaches, the table to
    one row per such number; the points are answered from that.
    """
    points = sorted(points)
    reached = F.lit(0)
    for t in points:
        reached = reached + (F.col(score) >= t).cast("int")
    bins = df.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    aggs = []
    for i in range(len(points)):
        hit = F.col("reached") > i
        aggs += [
            F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias(f"tp{i}"),
            F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias(f"fp{i}"),
        ]
    wide = bins.agg(*aggs, F.coalesce(F.sum("pos"), F.lit(0)).alias("p"))
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.col(f"tp{i}").alias("tp"),
                    F.col(f"fp{i}").alias("fp"),
                )
                for i, t in enumerate(points)
            ]
        )
    )
    long = wide.select(rows.alias("r"), "p").select("r.*", "p")
    return long.select(
        "threshold", *prf_columns(F.col("tp"), F.col("tp") + F.col("fp"), F.col("p"))
    )


def unit_edges(bins: int) -> list[float]:
    """Edges of equal bins on [0, 1]."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def _edges_below(x: Column, edges: Sequence[float], inclusive: bool) -> Column:
    n = F.lit(0)
    for e in edges:
        n = n + ((x >= e) if inclusive else (x > e)).cast("int")
    return n


def bin_stats(df: DataFrame, label: str, score: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean score and observed rate per left-closed bin, all bins that hold rows."""
    bin_no = _edges_below(F.col(score), unit_edges(bins), True) - 1
    return df.groupBy(*by, bin_no.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def expected_calibration_error(
    df: DataFrame, label: str, score: str, bins: int = C.ECE_BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Share-weighted gap between mean score and observed rate over left-closed bins.

    A score of exactly one lies beyond the last bin: it counts in the total only.
    """
    stats = bin_stats(df, label, score, bins, by)
    gap = F.abs(F.col("mean_score") - F.col("observed")) * F.col("n")
    inside = (F.col("bin") >= 0) & (F.col("bin") < bins)
    return stats.groupBy(*by).agg(
        (F.coalesce(F.sum(F.when(inside, gap)), F.lit(0.0)) / F.sum("n")).alias("ece")
    )


def calibration_curve(
    df: DataFrame, label: str, score: str, bins: int = C.ECE_BINS, places: int | None = None
) -> DataFrame:
    """Mean score and observed rate of the non-empty right-closed bins.

    Scores of `places` decimals are summed as whole numbers and the mean rounded likewise, so that it
    does not depend on the order of the rows.
    """
    bin_no = _edges_below(F.col(score), unit_edges(bins)[1:-1], False)
    mean = F.avg(score)
    if places is not None:
        unit = float(10**places)
        mean = F.round(F.sum(F.round(F.col(score) * unit).cast("long")) / F.count("*")) / unit
    return df.groupBy(bin_no.alias("bin")).agg(
        mean.alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed")
    )


def score_histogram(df: DataFrame, label: str, score: str, bins: int = C.SCORE_BINS) -> DataFrame:
    """Density histogram per class, each over its own range."""
    ends = df.groupBy(label).agg(
        F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.count("*").alias("_total")
    )
    flat = F.col("_lo") == F.col("_hi")
    # one row per class
    ends = ends.select(
        label,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
        "_total",
    )
    width = F.col("_hi") - F.col("_lo")
    place = F.floor((F.col(score) - F.col("_lo")) / width * bins)
    binned = df.join(F.broadcast(ends), label).groupBy(
        label, F.least(F.lit(bins - 1), place).cast("int").alias("bin"), "_lo", "_hi", "_total"
    )
    return binned.agg(F.count("*").alias("n")).select(
        F.col(label).alias("label"),
        "bin",
        "n",
        (F.col("n") / (F.col("_total") * (width / bins))).alias("density"),
    )


def slice_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per record and slice column; a null category is a category."""
    present = [c for c in columns if c in df.columns]
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("slice"),
                F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("category"),
            )
            for c in present
        ]
    )
    return df.select(*keep, F.explode(pairs).alias("_s")).select("_s.*", *keep)


def slice_metrics(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float,
    columns: Sequence[str] = C.CATEGORY_FIELDS,
    min_count: int = C.SLICE_MIN_COUNT,
) -> DataFrame:
    """All metrics for every category of every slice column with enough rows."""
    rows = slice_rows(df, columns, [label, score])
    out = all_metrics(rows, label, score, threshold, ["slice", "category"])
    return out.filter(F.col("count") >= min_count)


def metrics_long(wide: DataFrame, by: Sequence[str], names: Sequence[str] = C.METRICS) -> DataFrame:
    """(by, metric, value) rows; null values are left out."""
    return wide.unpivot(list(by), list(names), "metric", "value").filter(F.col("value").isNotNull())


def metric_deltas(
    df: DataFrame, baseline_label: str, label: str, score: str, threshold: float, split: str = "split"
) -> DataFrame:
    """Metrics per split under two label columns, at one threshold, and their difference."""
    pairs = F.array(
        F.struct(F.lit("baseline").alias("kind"), F.col(baseline_label).alias("y")),
        F.struct(F.lit("with_feedback").alias("kind"), F.col(label).alias("y")),
    )
    rows = df.select(F.col(split).alias("split"), F.col(score).alias("s"), F.explode(pairs).alias("p"))
    rows = rows.select("split", "s", "p.kind", "p.y")
    wide = all_metrics(rows, "y", "s", threshold, ["split", "kind"])
    long = metrics_long(wide, ["split", "kind"])
    both = long.groupBy("split", "metric").agg(
        F.max(F.when(F.col("kind") == "baseline", F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("kind") == "with_feedback", F.col("value"))).alias("with_feedback"),
    )
    return both.withColumn("delta", F.col("with_feedback") - F.col("baseline"))


def slice_delta(baseline: DataFrame, feedback: DataFrame) -> DataFrame:
    """Two slice tables side by side with the change of f1, precision and recall."""
    keys = ["slice", "category"]
    others = [c for c in baseline.columns if c not in keys]
    left = baseline.select(*keys, *[F.col(c).alias(f"{c}_baseline") for c in others])
    right = feedback.select(*keys, *[F.col(c).alias(f"{c}_feedback") for c in others])
    changes = {
        f"{m}_delta": F.col(f"{m}_feedback") - F.col(f"{m}_baseline")
        for m in ("f1", "precision", "recall")
    }
    return left.join(right, keys).withColumns(changes)


def weakest_slices(table: DataFrame, limit: int = 6) -> DataFrame:
    """Lowest F1 first, undefined last."""
    return table.orderBy(F.col("f1").asc_nulls_last(), "slice", "category").limit(limit)


def gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: the asymptotic series ten steps further on, and the way back.

    Nothing is a difference of large logarithms, so it holds for any number of rows.
    """
    z = a + 10
    log = (
        F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, F.lit(3))) - 1 / (640 * F.pow(z, F.lit(5)))
        + 17 / (14336 * F.pow(z, F.lit(7)))
    )
    back = F.aggregate(
        F.sequence(F.lit(0), F.lit(9)), F.lit(1.0), lambda p, i: p * (a + i) / (a + i + 0.5)
    )
    return F.exp(log) * back


#: Terms of the continued fraction; the larger side is always sought, where some 50 are enough.
BETA_TERMS = 300


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300

    def clear(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(state: Column, term: Column) -> Column:
        d = 1 / clear(1 + term * state["d"])
        c = clear(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def both(state: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        half = F.array(even, odd)
        return F.aggregate(half, state, step)

    d = 1 / clear(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BETA_TERMS)), start, both)["h"]


def correlation_p_value(rvalue: Column, free: Column) -> Column:
    """Two-sided p-value of a correlation with `free` degrees of freedom, as a column.

    The tail of Student's t is the regularised incomplete beta function of (free / 2, 1 / 2) at
    1 - r^2. A perfect correlation has 0; without a degree of freedom or a correlation it is null.
    """
    a, b = free.cast("double") / 2, F.lit(0.5)
    square = rvalue * rvalue
    x = (1 - rvalue) * (1 + rvalue)
    front = F.exp(a * F.log1p(-square)) * F.abs(rvalue) * gamma_ratio(a) / math.sqrt(math.pi)
    tail = F.when(x < (a + 1) / (a + 2.5), front / a * _beta_fraction(a, b, x)).otherwise(
        1 - front / b * _beta_fraction(b, a, square)
    )
    return (
        F.when((free <= 0) | rvalue.isNull() | F.isnan(rvalue), F.lit(None).cast("double"))
        .when(x <= 0, 0.0)
        .when(square == 0, 1.0)
        .otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    )


def probability_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x: slope, intercept, correlation, its p-value, standard error, size.

    One aggregation; all else is columns of its row.
    """
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    m = df.agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.corr(a, b).alias("rvalue"),
        F.regr_sxx(a, b).alias("_sxx"),
        F.regr_syy(a, b).alias("_syy"),
        F.regr_count(a, b).alias("n"),
    )
    free = F.col("n") - 2
    rest = (1 - F.col("rvalue") * F.col("rvalue")) * F.col("_syy") / F.col("_sxx")
    return m.select(
        "slope", "intercept", "rvalue", correlation_p_value(F.col("rvalue"), free).alias("pvalue"),
        F.sqrt(F.greatest(rest, F.lit(0.0)) / free).alias("stderr"), "n",
    )


def t_test_p_value(rvalue: float, n: int) -> float:
    """Two-sided p-value of a correlation, by integrating the t density numerically."""
    import numpy as np
    from math import lgamma, log, pi

    free = n - 2
    if free <= 0 or abs(rvalue) >= 1.0:
        return 0.0 if abs(rvalue) >= 1.0 else float("nan")
    t = abs(rvalue) * (free / (1 - rvalue * rvalue)) ** 0.5
    # substitute t = sqrt(free) * tan(u): the tail becomes an integral of cos(u)^(free-1)
    start = np.arctan(t / free**0.5)
    nodes, weights = np.polynomial.legendre.leggauss(400)
    u = (nodes + 1) / 2 * (pi / 2 - start) + start
    scale = lgamma((free + 1) / 2) - lgamma(free / 2) - 0.5 * log(pi)
    tail = np.sum(weights * np.exp(scale + (free - 1) * np.log(np.cos(u)))) * (pi / 2 - start) / 2
    return float(min(1.0, 2 * tail))
