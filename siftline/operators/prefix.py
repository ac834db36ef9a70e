"""Running sums over a global order without a single-task window.

A window ordered by score with no partition key would move every row to one task.
Here the rows are first combined to one per distinct value, the values are cut into
buckets at approximate quantiles, and each running sum is the sum inside the bucket plus
the total of the buckets before it. The quantiles only balance the buckets: any cut
points give the same exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions.text import col_of
from siftline.session import shuffle_width


def score_counts(
    df: DataFrame, label: str | Column, score: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score (and group)."""
    y = col_of(label)
    return df.groupBy(*by, col_of(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def running_sums(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Add `cum_<s>` (inclusive running sum) and `all_<s>` (group total) for each sum.

    `counts` holds one row per value and group; a null in a group column is a group like any
    other, rows without a value are left out. A group holding a third of all rows is
    spread over the buckets like the rest. The three uses of `counts` are kept alike
    (same columns, same filters), so that its one shuffle is reused.
    """
    by = list(by)
    buckets = buckets or shuffle_width(counts.sparkSession)
    shares = [i / buckets for i in range(1, buckets)]
    counts = counts.dropna(subset=[value])
    weighed = F.when(sum((F.col(s) for s in sums), F.lit(0)) >= 0, F.col(value))
    bounds = counts.agg(F.percentile_approx(weighed, shares, 10_000)).scalar()
    below = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    placed = (
        counts.withColumn("_bounds", bounds)
        .withColumn("_bucket", F.coalesce(below, F.lit(0)))
        .drop("_bounds")
    )
    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    # `buckets` rows per group
    group = W.partitionBy(*(by or [F.lit(0)]))
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    upto = group.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    offsets = totals.select(
        *by,
        "_bucket",
        *[(F.sum(s).over(upto) - F.col(s)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"all_{s}") for s in sums],
    )
    inside = (
        W.partitionBy(*by, "_bucket")
        .orderBy(F.col(value).desc() if descending else F.col(value).asc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    renamed = offsets.withColumnsRenamed({c: f"_of_{c}" for c in (*by, "_bucket")})
    same = F.col("_bucket") == F.col("_of__bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return placed.join(renamed, same).select(
        *counts.columns,
        *[(F.sum(s).over(inside) + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def cumulative_counts(
    df: DataFrame,
    label: str | Column,
    score: str | Column,
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Per distinct score, from high to low: counts of each class at or above it."""
    counts = score_counts(df, label, score, by)
    return running_sums(counts, "score", ["pos", "neg"], by, True, buckets)


def exact_percentiles(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Percentiles with linear interpolation, one array `percentiles` per group.

    Built on running counts, so no group's values are gathered in one task.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v"))
    runs = running_sums(counts.agg(F.count("*").alias("n")), "v", ["n"], by, False, buckets)
    picks = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("all_n") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n"))
            picks.append(F.max(F.when(held, F.col("v"))).alias(f"_{end}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_w{i}"))
    wide = runs.groupBy(*by).agg(*picks)
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")
        for i in range(len(shares))
    ]
    return wide.select(*by, F.array(*values).alias("percentiles"))
