"""Approximate nearest neighbours with a permutation index in pivot inverted files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pivots, and how many of the nearest stand for a vector, in order.
PIVOTS, PREFIX = 128, 48
#: Ranked exactly are this share of a shard and, beyond it, so many vectors for each neighbour asked for.
SHARE, EACH = 0.2, 8
SHARD_ROWS, QUERY_ROWS = 16_384, 1_024
NEIGHBOURS = 20

_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is not empty, all finite and not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    )


def pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """`count` rows with the smallest hash of the vector, repeats of a vector counted once."""
    first = vectors.select(F.xxhash64("v").alias("_h")).distinct().orderBy("_h").limit(count)
    rows = vectors.withColumn("_h", F.xxhash64("v")).join(F.broadcast(first), "_h")  # `count` hashes
    found = rows.groupBy("_h").agg(F.first("v").alias("v")).orderBy("_h").collect()
    return np.array([r.v for r in found], np.float32)


def _block(rows: DataFrame, by: str) -> DataFrame:
    """Rows of a block as one row of ids and numbers."""
    packed = F.sort_array(F.collect_list(F.struct("vec_id", "v")))
    return rows.groupBy(by).agg(packed.alias("x")).select(
        by, F.col("x.vec_id").alias("ids"), F.flatten(F.col("x.v")).alias("numbers")
    )


class Shard:
    """Vectors in the order of their ids, and for each pivot the vectors near it with its place.

    Footrule distance of two prefixes, with places beyond the prefix counted as `PREFIX`, is a
    constant less what each shared pivot saves, so the files of a query's own pivots are all it reads.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray):
        self.ids, self.exact, self.vectors = ids, vectors, vectors.astype(np.float32)
        self.centres = centres
        near = self.permutation(vectors)
        self.prefix = near.shape[1]
        owner = np.repeat(np.arange(len(ids)), self.prefix)
        place = np.tile(np.arange(self.prefix), len(ids))
        by = np.argsort(near.ravel(), kind="stable")
        cuts = np.searchsorted(near.ravel()[by], np.arange(1, len(centres)))
        self.members = np.split(owner[by], cuts)
        self.places = np.split(place[by].astype(np.int32), cuts)

    def permutation(self, vectors: np.ndarray) -> np.ndarray:
        """Pivots of each vector, nearest (largest inner product) first."""
        scores = vectors.astype(np.float32) @ self.centres.T
        return np.argsort(-scores, axis=1, kind="stable")[:, : min(PREFIX, len(self.centres))]

    def search(self, own: int, query: np.ndarray, order: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        saved = np.zeros(len(self.ids), np.int32)
        for at, pivot in enumerate(order.tolist()):
            place = self.places[pivot]
            saved[self.members[pivot]] += 2 * (self.prefix - np.maximum(place, at))
        # Equal distances go by id: rows are in that order and the sort is stable.
        take = int(SHARE * len(self.ids)) + EACH * count + int((self.ids == own).sum())
        far = (2 * self.prefix * self.prefix - saved).astype(np.uint16)
        near = np.argsort(far, kind="stable")[:take]
        near = near[self.ids[near] != own]
        # Ranked in single precision first; what may be among the best is ranked again in double.
        rough = self.vectors[near] @ query.astype(np.float32)
        if len(near) > count:
            slack = 1e-5 * float(np.abs(query).sum() * max(1e-30, np.abs(self.vectors[near]).max(initial=0)))
            near = near[rough >= np.partition(rough, -count)[-count] - slack]
        exact = self.exact[near] @ query
        best = np.lexsort((self.ids[near], -exact))[:count]
        return self.ids[near][best], exact[best]


def _search(centres, count: int) -> callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for frame in frames:  # a shard's vectors, then its blocks of queries, then the next shard
            for block, ids, numbers in zip(frame["block"], frame["ids"], frame["numbers"], strict=True):
                ids = np.asarray(ids, np.int64)
                vectors = np.asarray(numbers, np.float64).reshape(len(ids), -1)
                if block < 0:
                    shard = Shard(ids, vectors, centres.value)
                    continue
                if shard is None:
                    continue
                orders = shard.permutation(vectors)
                found = [shard.search(*q, count) for q in zip(ids.tolist(), vectors, orders, strict=True)]
                sizes = [len(f[0]) for f in found]
                if sum(sizes):
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat(ids, sizes),
                            "vec_id": np.concatenate([f[0] for f in found]),
                            "score": np.concatenate([f[1] for f in found]),
                        }
                    )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to `neighbours` vectors of each query, nearest first.

    Both sides are (vec_id, v) as `usable` makes them, of one dimension (others are left out); a
    query's own id is no candidate, ties go to the smaller id, repeated rows are rows each. Queries
    without any candidate have no row.

    Vectors are dealt into shards by hash. A shard keeps an inverted file for each pivot; a query reads
    the files of its own nearest pivots, ranks the shard by footrule distance and compares the best
    `SHARE` of it, and `EACH` more for each neighbour asked for, exactly. Queries pass every shard in blocks, in the order they arrive, so a task
    holds one shard and one block. The best of the shards are merged by query.
    """
    spark = vectors.sparkSession
    told = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if told is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors, queries = vectors.filter(F.size("v") == told.d), queries.filter(F.size("v") == told.d)
    centres = spark.sparkContext.broadcast(pivots(vectors))
    shards = max(1, -(-told.n // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    data = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    data = _block(data, "shard").withColumn("block", F.lit(-1))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = _block(asked, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = data.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    found = rows.select("block", "ids", "numbers").mapInPandas(_search(centres, neighbours), _FOUND)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, neighbours)
    merged = found.groupBy("query_id").agg(best.alias("x"))
    merged = merged.select("query_id", F.posexplode("x").alias("at", "x"))
    return merged.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )


def op7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
