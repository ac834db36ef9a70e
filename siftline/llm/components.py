"""Connected components of a table of links, with min-label stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import scratch_path

#: Links that a task contracts at a time (16 bytes each).
LOCAL = 1 << 17


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: the lineage ends there."""
    at = scratch_path(df.sparkSession, "links")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components: every node but the smallest of each hangs on that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        # The larger root of each link hangs on the smallest root that a link gives it, then all on their last.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, contracted whenever `LOCAL` of them have come."""
    u = v = np.empty(0, np.int64)
    held, waiting = [], 0

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        waiting += batch.num_rows
        if waiting >= LOCAL:
            u, v = stars(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
            held, waiting = [], 0
            if len(u) >= LOCAL:  # a forest that large is told, and forgotten
                yield table()
                u = v = np.empty(0, np.int64)
    u, v = stars(*(np.concatenate(x) for x in zip((u, v), *held, strict=True)))
    yield table()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node of a link.

    Tasks first contract the links they hold to stars. Up to `LOCAL` of these are contracted once more
    together, which ends it. Else each round is two aggregations and joins over the links, written and
    reread, until every node hangs on its root; rounds grow with the logarithm of the longest path. Nothing
    is gathered by node, so a star of any size is summed up map-side.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v")
    edges = _written(edges.mapInArrow(_contracted, "u long, v long"))
    told = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")]
    before = edges.agg(*told).first()
    if before.n <= LOCAL:
        edges, before = _written(edges.coalesce(1).mapInArrow(_contracted, "u long, v long")), None
    while before:
        edges = _written(_small_star(_large_star(edges)))  # the larger node first, as above
        after = edges.agg(*told).first()
        before = after if after != before else None
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def merged(parts: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """`parts` (node, component) after some more links, as a written table.

    The links are contracted to links of components first, so each round works on what is new only. A
    node that no link had yet is its own component.
    """
    for side in (a, b):
        of = parts.select(F.col("node").alias(side), F.col("component").alias("__of"))
        links = links.join(of, side, "left").withColumn(side, F.coalesce("__of", side)).drop("__of")
    found = _written(components(links, a, b))
    onto = found.select(F.col("node").alias("component"), F.col("component").alias("__onto"))
    moved = parts.join(onto, "component", "left").select("node", F.coalesce("__onto", "component").alias("component"))
    return _written(moved.unionByName(found.join(parts, "node", "left_anti")))
