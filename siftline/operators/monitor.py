"""Drift, weak slices, retraining, shadow comparison, scoring speed."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions.text import col_of
from siftline.operators.metrics import (
    expected_calibration_error,
    precision_recall_f1,
    slice_metrics,
)
from siftline.operators.prefix import exact_percentiles, running_sums
from siftline.operators.split import sample_batch


def ks_drift(recent: DataFrame, baseline: DataFrame, score: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: one row (statistic, n_recent, n_baseline)."""
    def counted(df, a, b):
        return df.select(F.col(score).cast("double").alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"))

    rows = counted(recent, 1, 0).unionByName(counted(baseline, 0, 1))
    counts = rows.groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    runs = running_sums(counts, "s", ["a", "b"], descending=False)
    gap = F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))
    return runs.agg(
        F.max(gap).alias("statistic"), F.sum("a").alias("n_recent"), F.sum("b").alias("n_baseline")
    )


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    x = math.sqrt(n * m / (n + m)) * statistic
    if x < 1e-9:
        return 1.0
    if x < 1.0:
        # the dual series converges fast for small arguments
        k = math.pi * math.pi / (8 * x * x)
        return 1.0 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * j - 1) ** 2) * k) for j in range(1, 20))
    tail = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 40))
    return min(1.0, max(0.0, tail))


def slice_alerts(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float,
    columns: Sequence[str],
    gap: float = C.SLICE_ALERT_GAP,
    min_count: int = C.SLICE_MIN_COUNT,
) -> DataFrame:
    """Slices whose F1 lies more than `gap` below the overall F1."""
    overall = precision_recall_f1(df, label, score, threshold).select("f1").scalar()
    table = slice_metrics(df, label, score, threshold, columns, min_count)
    flagged = table.select("slice", "category", "count", "f1").withColumn("overall_f1", overall)
    return flagged.filter(F.col("f1") < F.col("overall_f1") - gap)


def retrain_due(
    feedback: DataFrame,
    last_training: str | Column,
    as_of: str | Column,
    min_rows: int = C.RETRAIN_MIN_ROWS,
    max_days: int = C.RETRAIN_DAYS,
) -> DataFrame:
    """One row: new feedback rows, days passed, and whether either calls for training."""
    def stamp(t):
        return F.lit(t).cast("timestamp") if isinstance(t, str) else col_of(t)

    start, now = stamp(last_training), stamp(as_of)
    counted = feedback.filter(F.col("created_at") > start).agg(F.count("*").alias("new_rows"))
    days = (F.unix_timestamp(now) - F.unix_timestamp(start)) / 86400.0
    due = (F.col("new_rows") >= min_rows) | (F.col("days") >= max_days)
    return counted.withColumn("days", days).withColumn("due", due)


def shadow_compare(
    df: DataFrame,
    label: str,
    current: tuple[str, float],
    shadow: tuple[str, float],
    min_gain: float = C.SHADOW_GAIN,
    ece_slack: float = 0.0,
) -> DataFrame:
    """Two models on the same rows: F1 and calibration error of each, and the verdict.

    Each is a (score column, threshold) pair. The shadow is promoted when F1 rises by
    `min_gain` and its calibration error grows by no more than `ece_slack`.
    """
    cells = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(c).alias("s"), (F.col(c) >= t).alias("hit"))
            for kind, (c, t) in (("current", current), ("shadow", shadow))
        ]
    )
    rows = df.select(label, F.explode(cells).alias("_c")).select(label, "_c.*")
    f1 = precision_recall_f1(
        rows.withColumn("h", F.col("hit").cast("double")), label, "h", 0.5, ["kind"]
    ).select("kind", "f1")
    both = f1.join(expected_calibration_error(rows, label, "s", by=["kind"]), "kind")

    def of(kind, c):
        return F.max(F.when(F.col("kind") == kind, F.col(c)))

    wide = both.agg(
        of("current", "f1").alias("current_f1"),
        of("shadow", "f1").alias("shadow_f1"),
        of("current", "ece").alias("current_ece"),
        of("shadow", "ece").alias("shadow_ece"),
    )
    gain = F.col("shadow_f1") - F.col("current_f1")
    calm = F.col("shadow_ece") <= F.col("current_ece") + ece_slack
    return wide.withColumn("f1_gain", gain).withColumn("promote", (gain >= min_gain) & calm)


def scoring_benchmark(
    df: DataFrame,
    key: str,
    score: Callable[[DataFrame], DataFrame],
    sizes: Sequence[int] = C.BENCH_SIZES,
    repeats: int = C.BENCH_REPEATS,
    model_name: str = "model",
    model_type: str = "classical",
) -> DataFrame:
    """Time a scoring function on batches of each size: one row per size and repeat.

    Batches are drawn from the whole table before the clock starts.
    """
    spark = df.sparkSession
    rows = []
    score(sample_batch(df, key, max(sizes))).write.format("noop").mode("overwrite").save()
    for size in sizes:
        for repeat in range(repeats):
            batch = sample_batch(df, key, size, seed=repeat).drop("draw").persist()
            batch.count()
            start = time.perf_counter()
            score(batch).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            batch.unpersist()
            rows.append((model_name, model_type, size, repeat, spent * 1000, size / spent))
    return spark.createDataFrame(
        rows,
        "model_name string, model_type string, batch_size int, repeat int, "
        "latency_ms double, throughput_rps double",
    )


def latency_summary(table: DataFrame) -> DataFrame:
    """Median and 95th percentile latency (interpolated), mean throughput per batch size."""
    spread = exact_percentiles(table, "latency_ms", [0.5, 0.95], ["batch_size"])
    means = table.groupBy("batch_size").agg(F.avg("throughput_rps").alias("throughput_rps"))
    return spread.join(means, "batch_size").select(
        "batch_size",
        F.col("percentiles")[0].alias("latency_p50_ms"),
        F.col("percentiles")[1].alias("latency_p95_ms"),
        "throughput_rps",
    )


def benchmark_summary(table: DataFrame) -> DataFrame:
    """Mean and sample deviation of latency, mean throughput per batch size."""
    return table.groupBy("batch_size").agg(
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.stddev_samp("latency_ms").alias("std_latency_ms"),
        F.avg("throughput_rps").alias("mean_throughput_rps"),
    )
