"""Quality classifier: cumulative-link regression on graded ratings over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import words as wd

#: Hashed features (the weights are 4 bytes each), and labelled rows of a fit at most.
BITS = 20
MAX_LABELLED = 20_000
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 2e-5
#: Bytes that a word's stems have, and deviations from chance that a feature must show.
STEMS = (4, 5)
CHANCE = 4.0
#: Documents whose probability of the best grade is below this are rejected.
KEEP = 0.4

# Shares of a text that tell its style: byte classes, then repeated words and word length.
_CLASS = np.full(256, 4, np.uint8)  # other bytes
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_EDGES = np.array([0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8])


class Model(NamedTuple):
    """Shared weights and the ordered thresholds between grades 0, 1, 2, ..."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return _sigmoid(scores[:, None] - self.cuts[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _style(raw: np.ndarray, words: int, unique: int) -> np.ndarray:
    """Buckets of the binned style shares, and of how often each mark stands by a word."""
    byte = np.bincount(raw, minlength=256)
    count = np.bincount(_CLASS, byte, 5)
    solid, per = max(1.0, len(raw) - count[0]), max(1, words)
    shares = [count[2] / solid, count[3] / solid, count[4] / solid, unique / per, solid / per / 20]
    marks = np.flatnonzero((_CLASS == 4) & (byte > 0))
    kinds = np.r_[np.arange(5), 5 + marks].astype(np.uint64)
    bins = np.searchsorted(_EDGES, np.r_[shares, byte[marks] / per]).astype(np.uint64)
    return wd.mix(kinds * np.uint64(64) + bins + np.uint64(7))


def _word_features(data: np.ndarray, words: wd.Words) -> np.ndarray:
    """A word and its stems: what endings vary on is known by how it begins."""
    return np.stack([words.hash, *[wd.beginnings(data, words, n) for n in STEMS]], axis=1)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct feature buckets of every row: its words (letters and digits), stems and style."""
    offsets, data = wd.text_buffers(column)
    shift = np.uint64(64 - BITS)
    for row, found in wd.doc_hashes(column, wd.NOT_WORD, _word_features):
        words = np.unique((found >> shift).ravel())
        unique = len(np.unique(found[:, 0])) if len(found) else 0
        style = _style(data[offsets[row] : offsets[row + 1]], len(found), unique)
        yield np.unique(np.concatenate([words, style >> shift])).astype(np.int32)


def _telling(grades: np.ndarray, rows: list[np.ndarray], top: int) -> np.ndarray:
    """Features whose rows' grades differ from the others' by more than chance would make them."""
    seen, found = np.zeros(1 << BITS, np.int64), np.zeros((top, 1 << BITS), np.int64)
    for a in range(0, len(rows), wd.FEW):  # counts of few rows at a time, as each takes 8 bytes a feature
        part, high = rows[a : a + wd.FEW], grades[a : a + wd.FEW]
        seen += np.bincount(np.concatenate(part), minlength=1 << BITS)
        for k in range(top):
            above = [r for r, g in zip(part, high.tolist(), strict=True) if g > k]
            if above:
                found[k] += np.bincount(np.concatenate(above), minlength=1 << BITS)
    out = np.zeros(1 << BITS, bool)
    for k in range(top):
        share = (grades > k).mean()
        out |= np.abs(found[k] - seen * share) > CHANCE * np.sqrt(seen * share * (1 - share) + 1)
    return out


def slopes(score: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the log likelihood by each row's score, and of its sum by `theta` (first cut, log gaps)."""
    top = len(theta)
    cuts = np.cumsum(np.r_[theta[0], np.exp(theta[1:])])
    # Likelihood of grade g: tail(g - 1) - tail(g), with tail(-1) = 1 and tail(top) = 0.
    tails = np.c_[np.ones(len(grades)), _sigmoid(score[:, None] - cuts), np.zeros(len(grades))]
    at = np.arange(len(grades))
    upper, lower = tails[at, grades], tails[at, grades + 1]
    likely = np.maximum(upper - lower, 1e-9)
    d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
    by_cut = np.zeros(top + 2)
    np.add.at(by_cut, grades, -d_upper)
    np.add.at(by_cut, grades + 1, d_lower)
    by_cut = by_cut[1:-1]
    return d_upper - d_lower, np.r_[by_cut.sum(), [by_cut[k:].sum() * np.exp(theta[k]) for k in range(1, top)]]


def fit(grades: np.ndarray, rows: list[np.ndarray]) -> Model:
    """Maximise the cumulative-link likelihood by mini-batch gradient steps.

    P(grade > k) = sigmoid(w.x - cut_k), with w shared by all thresholds; the first cut is free,
    each next one is the one before plus exp(gap), so they stay in order. Rows are visited in a fixed
    shuffled order, so equal rows give an equal model.
    """
    top = int(grades.max(initial=0)) if len(grades) else 0
    if top == 0:  # nothing to tell apart: every text gets the best grade
        return Model(np.zeros(1 << BITS, np.float32), np.full(max(top, 1), -40.0))
    telling = _telling(grades, rows, top)
    rows = [r[telling[r]] for r in rows]
    rng = np.random.default_rng(7)
    w = np.zeros(1 << BITS)
    share = np.array([(grades > k).mean() for k in range(top)]).clip(0.01, 0.99)
    start = -np.log(share / (1 - share))
    theta = np.r_[start[0], np.log(np.maximum(np.diff(start), 0.05))]
    size, speed = np.zeros(1 << BITS), np.zeros(top)
    lengths = np.array([len(r) for r in rows])
    flat, ends = np.concatenate(rows), np.cumsum(lengths)
    del rows
    for epoch in range(EPOCHS):
        order = rng.permutation(len(lengths))
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 10
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            n = lengths[part]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = flat[np.repeat(ends[part] - n, n) + within]
            owner = np.repeat(np.arange(len(part)), n)
            score = np.bincount(owner, w[x], len(part))
            by_row, by_theta = slopes(score, grades[part], theta)
            touched, inverse = np.unique(x, return_inverse=True)
            grad = np.bincount(inverse, by_row[owner], len(touched))
            size[touched] += grad**2
            w[touched] += rate * 10 * grad / np.sqrt(size[touched] + 1.0)
            w[touched] *= 1 - DECAY * BATCH
            speed += by_theta**2
            theta += rate * 5 * by_theta / np.sqrt(speed + 1.0)
    cuts = np.cumsum(np.r_[theta[0], np.exp(theta[1:])])
    return Model(w.astype(np.float32), cuts)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of rows (grade, x), whose buckets are held once, 4 bytes each."""
    grades, rows = [], []
    for batch in batches:
        grades.append(batch.column(0).to_numpy())
        flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(batch.column(1).value_lengths().to_numpy())
        rows += np.split(flat.copy(), ends[:-1]) if len(ends) else []  # a copy, so that the batch goes
    if rows:
        model = fit(np.concatenate(grades), rows)
        told = [[model.weights.tobytes()], [model.cuts.astype(np.float64).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()) for t in told], names=["w", "c"])


def train(docs: DataFrame, grades: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Model:
    """Model from `grades` (key, grade: 0 worst) and the texts of those documents.

    Rows without a key or grade are left out. If there are more than `max_labelled`, those with the
    smallest hash of the key are taken: this bounded sample alone is gathered. Texts become feature
    buckets where they are read; a key that repeats in `docs` counts once, by its least list of buckets, so
    the fit is one task over the sample however often a key occurs. A model without labels gives every
    text the best grade.
    """
    rated = grades.select(F.col(key).alias("_key"), F.col("grade").cast("int").alias("grade")).dropna()
    sample = rated.orderBy(F.xxhash64("_key"), "_key", "grade").limit(max_labelled)
    texts = docs.select(F.col(key).alias("_key"), "text").join(F.broadcast(sample), "_key")  # bounded

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.few(batches):
            each = list(features(batch.column(1)))
            ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
            found = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *each]))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], names=["grade", "x", "_key"])

    rows = texts.select("grade", "text", F.col("_key").cast("long").alias("_key")).mapInArrow(
        hashed, "grade int, x array<int>, _key long"
    )
    rows = rows.groupBy("_key", "grade").agg(F.min("x").alias("x"))
    rows = rows.repartition(1).sortWithinPartitions("_key", "grade").select("grade", "x")
    with wd.batch_rows(docs.sparkSession, wd.FEW):
        out = rows.mapInArrow(_fitted, "w binary, c binary").collect()
    if not out:
        return fit(np.zeros(0, np.int64), [])
    return Model(np.frombuffer(bytes(out[0].w), np.float32), np.frombuffer(bytes(out[0].c), np.float64))


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """`docs` with `expected_grade`, `p_best` and `keep` (a column of such a name is replaced).

    `p_best` is the probability of the best grade, the tail beyond the last threshold. Null and
    empty texts have no words and are scored by their style alone. Repeated rows are each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    names = [c for c in docs.columns if c not in ("expected_grade", "p_best", "keep")]
    df = docs.select(*names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        for batch in wd.few(batches):
            total = np.array([weights[f].sum() for f in features(batch.column(at))], np.float64)
            tails = Model(weights, cuts).tails(total.reshape(-1))
            best = tails[:, -1]
            columns = [pa.array(tails.sum(axis=1)), pa.array(best), pa.array(best >= keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "expected_grade", "p_best", "keep"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", expected_grade double, p_best double, keep boolean"
    return df.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Rows of `docs` that `score` would mark with `keep`, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        for batch in wd.few(batches):
            total = np.array([weights[f].sum() for f in features(batch.column(at))], np.float64)
            yield batch.filter(pa.array(Model(weights, cuts).tails(total.reshape(-1))[:, -1] >= keep))

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of `labels` as grades: 0 toxic, 1 of low quality, 2 good."""
    grade: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = score(docs, train(docs, graded(labels)))
    return scored.select("doc_id", "expected_grade", "p_best", "keep")
