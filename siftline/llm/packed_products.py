"""Hard negatives by exact integer products of which several are made by one multiplication.

Kronecker packing: the components of several candidates are biased so that none is negative and laid
side by side, as fields of one wide integer. A wide integer times an anchor's (biased) component is all
of these candidates' products at once; fields are wide enough for the sum over all components, so the sums
never run into each other and are read off exactly, less what the biases added.

Wide integers of up to 53 bits are kept in doubles, which hold them exactly, so a block of anchors is one
matrix product. Components too large for that are packed in Python's integers of any width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a shard at most (on average), and anchors that are multiplied at a time.
SHARD_ROWS, ANCHOR_ROWS = 65_536, 64
#: Rows a shard has at least before the table is cut into more of them.
LEAST_ROWS = 2_048
POSITIVES, NEGATIVES = 5, 10
#: A component x counts as floor(SCALE * x); a negative's score lies between these shares of the positive's.
SCALE = 256
LOW, HIGH = (30, 100), (90, 100)

_EXACT = 53
_LONG = np.iinfo(np.int64)


# --- Exact scores inside a task


def quantised(numbers: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as int64; as Python's integers where one does not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(numbers * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2.0**60:
        return scaled.astype(np.int64)
    exact = [int(s) if np.isfinite(s) else int(x) * SCALE for s, x in zip(scaled.tolist(), numbers.tolist(), strict=True)]
    return np.array(exact, object)


def _bits(*sides: np.ndarray) -> int:
    """Bits of the largest distance inside each side, together."""
    return sum((int(s.max()) - int(s.min())).bit_length() for s in sides)


class Packed:
    """Rows of integers, several in one wide integer for each component; kept for the width last asked for."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.bits, self.wide = 0, None
        if rows.size:
            self.low, self.high = int(rows.min()), int(rows.max())

    def _doubles(self, bits: int) -> None:
        """Wide integers of as many fields of `bits` as a double holds exactly."""
        fields, n = _EXACT // bits, len(self.rows)
        if isinstance(self.wide, np.ndarray) and self.bits >= bits and _EXACT // self.bits == fields:
            return
        wide = np.zeros((-(-n // fields), self.rows.shape[1]), np.int64)
        for f in range(fields):
            part = self.rows[f::fields].astype(np.int64) - self.low
            wide[: len(part)] += part << (f * bits)
        self.bits, self.wide = bits, np.ascontiguousarray(wide.T.astype(np.float64))

    def _sums(self, anchors: np.ndarray, bits: int) -> np.ndarray:
        """Sums of biased products: one multiplication a component for all candidates of a wide integer."""
        self._doubles(bits)
        fields = _EXACT // self.bits
        product = (anchors.astype(np.float64) @ self.wide).astype(np.int64)
        out = np.empty((len(anchors), product.shape[1] * fields), np.int64)
        for f in range(fields):
            out[:, f::fields] = (product >> (f * self.bits)) & ((1 << self.bits) - 1)
        return out[:, : len(self.rows)]

    def _wide_sums(self, anchors: np.ndarray, bits: int) -> np.ndarray:
        """The same with one integer of any width for each component of all candidates."""
        size = -(-bits // 8)
        if not isinstance(self.wide, list) or self.bits != size:
            columns = ([int(x) - self.low for x in column] for column in self.rows.T)
            self.wide = [int.from_bytes(b"".join(x.to_bytes(size, "little") for x in c), "little") for c in columns]
            self.bits = size
        out = np.empty((len(anchors), len(self.rows)), object)
        for i, anchor in enumerate(anchors):
            total = sum(int(x) * w for x, w in zip(anchor, self.wide, strict=True))
            raw = total.to_bytes(size * len(self.rows), "little")
            out[i] = [int.from_bytes(raw[k : k + size], "little") for k in range(0, len(raw), size)]
        return out

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of all anchors with all rows: int64, or Python's integers where needed."""
        if not self.rows.size or not anchors.size:
            return np.zeros((len(anchors), len(self.rows)), np.int64)
        d = anchors.shape[1]
        # Any sum of products of biased numbers is below 2 ** bits.
        bits = max(1, _bits(anchors, self.rows) + d.bit_length())
        low = int(anchors.min())
        largest = max(abs(low), int(anchors.max())) * max(abs(self.low), abs(self.high)) * d
        if bits <= _EXACT and largest < 2**60:
            sums, kind = self._sums(anchors - low, bits), np.int64
        else:
            sums, kind = self._wide_sums(np.array([[int(x) - low for x in a] for a in anchors], object), bits), object
        by_anchor = anchors.astype(kind).sum(axis=1) * self.low
        by_row = self.rows.astype(kind).sum(axis=1) * low
        # (a - x)(r - y) summed is ar - ya - xr + dxy, with the biases x and y.
        return sums + by_anchor[:, None] + by_row[None, :] - d * low * self.low


class Shard:
    """Candidates in the order of their labels, then ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        by = np.lexsort((ids, labels))
        self.ids, self.labels, self.rows = ids[by], labels[by], Packed(rows[by])
        self.of: dict[int, Packed] = {}

    def span(self, label: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return int(a), int(b)

    def positives(self, label: int, own: np.ndarray, anchors: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, list]]:
        """For each anchor of one label: ids and scores of its best rows of that label."""
        a, b = self.span(label)
        if label not in self.of:
            self.of[label] = Packed(self.rows.rows[a:b])
        scores = self.of[label].products(anchors)
        for key, line in zip(own.tolist(), scores, strict=True):
            best = np.flatnonzero(self.ids[a:b] != key)
            if len(best) > 4 * count and line.dtype != object:
                best = best[line[best] >= np.partition(line[best], -count)[-count]]
            best = best[_order(line[best], self.ids[a:b][best])][:count]
            yield self.ids[a:b][best], line[best].tolist()

    def negatives(
        self, label: int, own: np.ndarray, anchors: np.ndarray, levels: list[list[int]], count: int
    ) -> Iterator[list[tuple[np.ndarray, list]]]:
        """For each anchor of one label and each of its positives' scores: the best rows inside the band."""
        a, b = self.span(label)
        scores = self.rows.products(anchors)
        for key, line, given in zip(own.tolist(), scores, levels, strict=True):
            bands = [(-(-LOW[0] * p // LOW[1]), HIGH[0] * p // HIGH[1]) for p in given]
            low, high = min(x for x, _ in bands), max(x for _, x in bands)
            at = np.flatnonzero((line >= low) & (line <= high))
            at = at[((at < a) | (at >= b)) & (self.ids[at] != key)]
            at = at[_order(line[at], self.ids[at])]
            falling = -line[at]
            found = []
            for x, y in bands:
                first = int(np.searchsorted(falling, -y))
                take = at[first : min(first + count, int(np.searchsorted(falling, -x, side="right")))]
                found.append((self.ids[take], line[take].tolist()))
            yield found


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    by = np.argsort(ids, kind="stable")
    return by[np.argsort(-scores[by], kind="stable")]


def _long(scores: list[int]) -> list[int]:
    return [min(max(int(s), _LONG.min), _LONG.max) for s in scores]


# --- A stream of shards, each followed by the anchors


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)


def _stream(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[Shard, np.ndarray, dict]]:
    """(shard, anchors, their columns): rows come by shard, candidates before anchors."""
    number, held, shard = None, [], None
    for batch in batches:
        part = dict(zip(batch.schema.names, batch.columns, strict=True))
        at = part["shard"].to_numpy(), part["asks"].to_numpy()
        cuts = np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
            if a == b:
                continue
            own = {k: v.slice(a, b - a) for k, v in part.items()}
            if at[0][a] != number:
                number, held, shard = at[0][a], [], None
            if not at[1][a]:
                held.append((own["vec_id"].to_numpy(), own["label"].to_numpy(), _numbers(own["v"])))
                continue
            if not held and shard is None:
                continue
            if shard is None:
                ids, labels, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
                shard, held = Shard(ids, labels, quantised(numbers).reshape(len(ids), -1)), []
            asked = own["label"].to_numpy()
            by = np.argsort(asked, kind="stable")
            vectors = quantised(_numbers(own["v"])).reshape(b - a, -1)
            for label in np.unique(asked).tolist():
                same = by[np.searchsorted(asked[by], label) : np.searchsorted(asked[by], label, side="right")]
                for c in range(0, len(same), ANCHOR_ROWS):
                    some = same[c : c + ANCHOR_ROWS]
                    yield shard, vectors[some], {"label": label} | {k: own[k].take(pa.array(some)) for k in names}


def _find_positives(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, vectors, asked in _stream(batches, ["vec_id", "anchor"]):
            own = asked["vec_id"].to_numpy()
            found = list(shard.positives(asked["label"], own, vectors, count))
            sizes = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(asked["anchor"].to_numpy(), sizes)),
                    pa.array(np.repeat(own, sizes)),
                    pa.array(np.concatenate([f[0] for f in found])),
                    pa.array(_long([s for f in found for s in f[1]]), pa.int64()),
                ],
                names=["anchor", "anchor_id", "positive_id", "positive_score"],
            )

    return run


def _find_negatives(count: int):
    names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, vectors, asked in _stream(batches, ["vec_id", "anchor", "positives", "levels"]):
            own, keys = asked["vec_id"].to_numpy(), asked["anchor"].to_pylist()
            positives, levels = asked["positives"].to_pylist(), asked["levels"].to_pylist()
            out: list[list] = [[] for _ in names]
            for i, found in enumerate(shard.negatives(asked["label"], own, vectors, levels, count)):
                for place, (ids, scores) in enumerate(found):
                    n = len(ids)
                    values = (keys[i], int(own[i]), place, positives[i][place], levels[i][place])
                    for column, value in zip(out, values, strict=False):
                        column.extend([value] * n)
                    out[5].extend(ids.tolist())
                    out[6].extend(_long(scores))
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


# --- The plan


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): rows with an id, a label and a vector of finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.filter(kept).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))


def _first(df: DataFrame, by: list[str], score: str, key: str, count: int) -> DataFrame:
    """The `count` rows of each group with the largest score, then smallest key, numbered from 1 in `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` as `usable` makes them.

    `anchors` is true for the rows that ask. An anchor's positives are its best rows of the same label;
    its negatives for a positive are the best rows of other labels with a score between `LOW` and `HIGH`
    of the positive's. Rows with the anchor's own id are no candidates. Repeated rows are rows each, but
    equal anchors ask once. Vectors of another dimension than most have are left out; scores beyond a
    long are cut to its range. Anchors without a positive or negative have no row.

    Every anchor meets every row, in blocks: rows are dealt into shards by hash, anchors go to each
    shard, and a task holds one shard and one batch of anchors. Only the best of a shard leave it: first
    the positives, which then tell the bands of a second pass over the shards.
    """
    spark = vectors.sparkSession
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    told = sizes.filter(F.col("d") > 0).orderBy(F.desc("n"), "d").first()
    if told is None:
        return spark.createDataFrame([], ROWS)
    vectors = vectors.filter(F.size("v") == told.d)
    shards = max(-(-told.n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-told.n // LEAST_ROWS)))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    rows = vectors.withColumn("shard", shard).withColumn("asks", F.lit(0))
    asking = vectors.filter(anchors).withColumn("anchor", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["vec_id", "anchor"])

    def met(asked: DataFrame) -> DataFrame:
        everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(1))
        both = rows.unionByName(everywhere, allowMissingColumns=True)
        return both.repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    found = met(asking).mapInArrow(_find_positives(positives), "anchor long, anchor_id long, positive_id long, positive_score long")
    found = _first(found, ["anchor_id", "anchor"], "positive_score", "positive_id", positives)
    told_best = found.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("x"))
    told_best = told_best.select(F.col("anchor_id").alias("vec_id"), "anchor", F.col("x.positive_id").alias("positives"), F.col("x.positive_score").alias("levels"))
    kinds = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = met(asking.join(told_best, ["vec_id", "anchor"])).mapInArrow(_find_negatives(negatives), kinds)
    hard = _first(hard, ["anchor_id", "anchor", "place"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ROWS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = f"""
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
), banded AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM banded WHERE rank <= {NEGATIVES}
"""
