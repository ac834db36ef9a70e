"""Seeded train / validation / test assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline import constants as C
from siftline.functions.text import col_of

NAMES = ("train", "val", "test")
HASH_RANGE = 1 << 32


def seeded_hash(key: str | Column, seed: int = C.SPLIT_SEED) -> Column:
    """Uniform integer in [0, 2^32) from the key; the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), col_of(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_split(
    df: DataFrame,
    key: str,
    shares: Sequence[float] = C.SPLIT_SHARES,
    seed: int = C.SPLIT_SEED,
) -> DataFrame:
    """Split by hash band: no shuffle at all, shares hold in expectation."""
    first = int(round(shares[0] * 10_000))
    second = int(round((shares[0] + shares[1]) * 10_000))
    band = F.pmod(seeded_hash(key, seed), F.lit(10_000))
    return df.withColumn(
        "split", F.when(band < first, NAMES[0]).when(band < second, NAMES[1]).otherwise(NAMES[2])
    )


def stratified_split(
    df: DataFrame,
    key: str,
    label: str | None,
    shares: Sequence[float] = C.SPLIT_SHARES,
    seed: int = C.SPLIT_SEED,
    buckets: int = 4096,
) -> DataFrame:
    """Exact shares inside every label, rows in seeded-hash order.

    The rows are never sorted or shuffled. Counts per (label, hash bucket) say in which
    bucket each cut falls; only the rows of those buckets, one in `buckets`, are ranked
    to find the last row of a split; every row then compares itself with its label's
    two cuts. Hash buckets are even whatever the data look like. There are few labels,
    so the table of cuts is small by nature.
    """
    strata = F.col(label) if label else F.lit(0)
    h = seeded_hash(key, seed)
    narrow = df.select(strata.alias("_label"), h.alias("_h"), F.col(key).alias("_id")).withColumn(
        "_bucket", F.floor(F.col("_h") / (HASH_RANGE // buckets))
    )
    counts = narrow.groupBy("_label", "_bucket").agg(F.count("*").alias("_n"))
    by_label = W.partitionBy("_label")
    upto = by_label.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.select(
        "_label",
        "_bucket",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_after"),
        F.sum("_n").over(by_label).alias("_total"),
    )
    cut_shares = [(NAMES[0], shares[0]), (NAMES[1], shares[0] + shares[1])]
    cuts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    F.floor(F.col("_total") * round(share, 10) + 0.5).alias("k"),
                )
                for name, share in cut_shares
            ]
        )
    )
    wanted = placed.select("*", cuts.alias("_cut")).filter(
        (F.col("_before") < F.col("_cut.k")) & (F.col("_cut.k") <= F.col("_after"))
    )
    # at most two rows per label
    wanted = wanted.select(
        "_label", "_bucket", "_cut.name", (F.col("_cut.k") - F.col("_before")).alias("_nth")
    )
    ranked = narrow.join(F.broadcast(wanted), ["_label", "_bucket"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy("_label", "_bucket", "name").orderBy("_h", "_id"))
    )
    bounds = (
        ranked.filter(F.col("_rank") == F.col("_nth"))
        .groupBy("_label")
        .agg(
            *[
                F.max(F.when(F.col("name") == n, F.struct("_h", "_id"))).alias(f"_{n}")
                for n, _ in cut_shares
            ]
        )
    )
    row = F.struct(h.alias("_h"), F.col(key).alias("_id"))
    split = (
        F.when(F.col("_label").isNull(), None)  # no label, no split
        .when(row <= F.col("_train"), NAMES[0]).when(row <= F.col("_val"), NAMES[1]).otherwise(NAMES[2])
    )
    return (
        df.withColumn("_label", strata)
        .join(F.broadcast(bounds), "_label", "left")
        .withColumn("split", split)
        .select(*df.columns, "split")
    )


def split_summary(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("positive_share")
    )


def sample_batch(df: DataFrame, key: str, size: int, seed: int = C.SPLIT_SEED) -> DataFrame:
    """`size` rows in seeded order, repeated in turn when the table is smaller.

    Top-k by hash, so no full sort. Repeats cycle over the `size` rows kept at most.
    """
    rows = df.withColumn("_h", seeded_hash(key, seed)).orderBy("_h", key).limit(size)
    n = rows.agg(F.count("*")).scalar()
    place = W.partitionBy(F.lit(0)).orderBy("_h", key)  # at most `size` rows
    rows = rows.withColumn("_pos", F.row_number().over(place) - 1)
    repeats = F.floor((F.lit(size - 1) - F.col("_pos")) / n)
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), repeats.cast("int")))).drop(
        "_h", "_pos"
    )
