"""Metric states that add up: exact score counts by day and slice, as a written table.

A state row is the number of positives and negatives with one exact score. States of
several days are added by a sum over (slice, category, score), and every metric is a function
of these sums, so the metrics of a month come from its daily states and equal those of a scan of
all its records. A new day, or one that is scored again, reads and writes only itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.operators.metrics import metrics_of_counts, slice_rows

ALL = "all"
KEYS = ("slice", "category")


def daily_states(
    df: DataFrame, label: str, score: str, time: str, columns: Sequence[str] = C.CATEGORY_FIELDS
) -> DataFrame:
    """(day, slice, category, score, pos, neg), day as yyyyMMdd in the session's time zone.

    Slice `all` with category `all` holds every record. Records without a score, a label of 0
    or 1 or a time count nowhere; a null category is the category `nan`.
    """
    ready = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull() & F.col(time).isNotNull())
    keep = {
        "_day": F.date_format(time, "yyyyMMdd"),
        "_score": F.col(score).cast("double"),
        "_label": F.col(label).cast("int"),
        "_everything": F.lit(ALL),
    }
    rows = slice_rows(ready.withColumns(keep), ["_everything", *columns], ["_day", "_score", "_label"])
    whole = F.col("slice") == "_everything"
    named = rows.withColumn("slice", F.when(whole, ALL).otherwise(F.col("slice")))
    return named.groupBy(F.col("_day").alias("day"), *KEYS, F.col("_score").alias("score")).agg(
        F.count_if(F.col("_label") == 1).alias("pos"), F.count_if(F.col("_label") == 0).alias("neg")
    )


def write_states(states: DataFrame, root: str) -> None:
    """Write whole days; a day that is there is replaced, others are not touched."""
    states.repartition("day", F.pmod(F.xxhash64("score"), F.lit(16))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(root)


def read_states(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """States of the days from `first` to `last` (yyyyMMdd, both included); other days are not read."""
    schema = "slice string, category string, score double, pos long, neg long, day string"
    states = spark.read.schema(schema).parquet(root)
    if first is not None:
        states = states.filter(F.col("day") >= first)
    if last is not None:
        states = states.filter(F.col("day") <= last)
    return states


def add_states(states: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """States summed over everything but `by` and the score."""
    return states.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def metrics_of_states(
    states: DataFrame, threshold: float, by: Sequence[str] = KEYS, min_count: int = 1
) -> DataFrame:
    """Every metric of `metrics.all_metrics` for each group, from states instead of records.

    `by` may hold `day` too: one row for each day.
    """
    out = metrics_of_counts(add_states(states, by), threshold, by)
    return out.filter(F.col("count") >= min_count)
