"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon (words and beginnings of words that toxic rows hold more often than
chance), nearness of its words to second-person words, capitals, punctuation, and how much a text hides its
letters. The lexicon is learned from the labelled rows; a row that trees are fitted on is described
by a lexicon of the other rows, as a new text would be, and the calibration sees such scores only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import words as wd

#: Labelled rows of a fit, and entries of the lexicon, at most.
MAX_LABELLED, LEXICON = 20_000, 8_192
#: Bytes of a word's beginnings, rows and deviations from chance that an entry needs.
STEMS = (4, 5, 6)
LEAST, CHANCE = 4, 4.0
FOLDS = 4
#: Logarithms of the odds of a toxic row, from which an entry is telling or strong.
TELLING, STRONG = 1.0, 3.0
#: Words between a lexicon word and a second-person word that are near each other, at most.
NEAR = 5
ROUNDS, DEPTH, RATE, BINS, PENALTY, HESSIAN = 120, 3, 0.1, 64, 1.0, 2.0

# Second-person words of the languages covered.
SECOND = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie ihnen tu toi te ton ta tes vous votre vos "
    "tú ti usted ustedes tus vosotros os vuestro"
).split()

NAMES = [
    "telling", "strong", "weight", "telling_words", "strong_words", "largest", "hidden", "hidden_words",
    "second", "near", "near_words", "capitals", "shouted", "marks", "shouts", "asks", "repeated_marks",
    "masked", "stretched", "mixed", "single", "words", "length",
]


# --- Features

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = ~(_LETTER | wd.SPACE)
_MARK[[*range(32), *range(48, 58)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Signs that stand for letters.
_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip(b"013457@$", b"oieastas", strict=True):
    _PLAIN[_sign] = _letter


_TOP = np.uint64(64 - 18)


class Lexicon(NamedTuple):
    """Sorted hashes of words and beginnings of words, their logarithms of odds, and which top bits occur."""

    keys: np.ndarray
    weights: np.ndarray
    tops: np.ndarray

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """The largest weight among the keys of each word, 0 where none is known."""
        out = np.zeros(found.size)
        flat = found.ravel()
        likely = np.flatnonzero(self.tops[flat >> _TOP])
        if len(likely):
            sought = flat[likely]
            at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
            out[likely] = np.where(self.keys[at] == sought, self.weights[at], 0.0)
        return out.reshape(found.shape).max(axis=1)


def lexicon(keys: np.ndarray, weights: np.ndarray) -> Lexicon:
    """A lexicon of sorted hashes."""
    tops = np.zeros(1 << (64 - int(_TOP)), bool)
    tops[keys >> _TOP] = True
    return Lexicon(keys, weights, tops)


def word_keys(data: np.ndarray, words: wd.Words) -> np.ndarray:
    """Hashes of a word and of its beginnings, which endings vary on; a short word has no beginnings."""
    out = [words.hash]
    stem = np.zeros(len(words.start), np.uint64)
    for j in range(max(STEMS)):
        at = words.start + j
        inside = at < words.end
        byte = data[np.minimum(at, len(data) - 1)]
        stem = stem * np.uint64(257) + np.where(inside, _LOWER[byte], 0).astype(np.uint64)
        if j + 1 in STEMS:
            out.append(np.where(at + 1 < words.end, wd.mix(stem + np.uint64(j + 1)), words.hash))
    return np.stack(out, axis=1)


def _revealed(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text without marks, with letters for the signs that stand for them, and threefold letters once."""
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    same[offsets[:-1][offsets[:-1] < len(data)]] = False  # a text's first byte continues nothing
    # A byte goes if it continues a run of three or more equal letters.
    first = np.flatnonzero(~same)
    size = np.diff(np.r_[first, len(data)])
    long = np.repeat(size >= 3, size) & same & _LETTER[data]
    stays = ~(long | (_MARK[data] & (_PLAIN[data] == data)))
    return np.r_[0, np.cumsum(stays)][offsets], _PLAIN[data[stays]]


def _hash_of(words: list[str]) -> np.ndarray:
    return np.sort(np.array([h for _, row in wd.doc_hashes(pa.array(words), wd.NOT_WORD) for h in row], np.uint64))


_SECOND = _hash_of(SECOND)


def _per_word(offsets: np.ndarray, data: np.ndarray, separator: np.ndarray, of) -> tuple[np.ndarray, np.ndarray]:
    """(row, of(window)) of every word of a batch."""
    docs, values = [np.empty(0, np.int64)], []
    for words in wd.word_windows(offsets, data, separator):
        docs.append(words.doc)
        values.append(of(words))
    return np.concatenate(docs), np.concatenate(values) if values else np.empty(0)


def _dense(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of flags of each text."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def features(column: pa.Array, known: Lexicon) -> np.ndarray:
    """A row of `NAMES` for each text; a null or empty text has zeros."""
    offsets, data = wd.text_buffers(column)
    offsets, data = offsets - offsets[0], data[offsets[0] : offsets[-1]]
    n = len(column)

    def weigh(words: wd.Words) -> np.ndarray:
        second = np.isin(words.hash, _SECOND)
        return np.stack([known(word_keys(data, words)), second, words.start, words.end - words.start], axis=1)

    doc, told = _per_word(offsets, data, wd.NOT_WORD, weigh)
    weight, second, word_start, size = told.reshape(-1, 4).T
    second = second > 0
    count = lambda at, by=None: np.bincount(at, by, n)[:n]
    telling, strong = weight >= TELLING, weight >= STRONG
    words = count(doc)
    per = np.maximum(words, 1)
    # Words at most NEAR places apart in one text.
    beside = np.zeros(len(doc), bool)
    for k in range(1, NEAR + 1):
        one = doc[k:] == doc[:-k]
        beside[k:] |= one & second[:-k]
        beside[:-k] |= one & second[k:]
    largest = np.zeros(n)
    np.maximum.at(largest, doc, weight)

    # White-space tokens as they would be without their disguise.
    clear_at, clear = _revealed(offsets, data)
    clear_doc, found = _per_word(clear_at, clear, wd.SPACE, lambda w: known(word_keys(clear, w)))
    hidden = np.maximum(0, count(clear_doc[found >= TELLING]) - count(doc[telling]))

    # Most flags are rare, so their places are dealt to tokens and texts.
    letter = _LETTER[data]
    capital, mark = (np.flatnonzero(kind[data]) for kind in (_CAPITAL, _MARK))
    rows = lambda places: np.searchsorted(offsets, places, side="right") - 1
    totals = lambda places: count(rows(places))
    token_doc, span = _per_word(offsets, data, wd.SPACE, lambda w: np.stack([w.start, w.end], axis=1))
    start, end = span.reshape(-1, 2).astype(np.int64).T
    tokens = np.maximum(count(token_doc), 1)

    def holds(places: np.ndarray, start: np.ndarray = start) -> np.ndarray:
        """How many of some places each token has."""
        return np.bincount(np.searchsorted(start, places, side="right") - 1, minlength=len(start))[: len(start)]

    def share(flags: np.ndarray) -> np.ndarray:
        return count(token_doc, flags) / tokens

    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    around = np.r_[letter, False]  # also what is left of the first byte
    left, right = (lambda at: around[at - 1] & ~edge[at]), (lambda at: around[at + 1] & ~edge[at + 1])
    again = np.flatnonzero(data[1:] == data[:-1]) + 1
    again = again[rows(again) == rows(again - 1)]
    thrice = again[1:][np.diff(again) == 1]
    signs = np.flatnonzero(_PLAIN[data] != data)
    lettered = np.maximum(_dense(letter, offsets), 1)
    solid = np.maximum(np.diff(offsets) - _dense(wd.SPACE[data], offsets), 1)
    shares = [
        count(doc, (size > 1) & (holds(capital, word_start) == size)) / per,
        share(holds(mark[left(mark) & right(mark)]) > 0),
        share(holds(thrice[letter[thrice]]) > 0),
        share(holds(signs[left(signs) | right(signs)]) > 0),
        share(end - start == 1),
    ]
    repeated = again[_MARK[data[again]]]
    out = [
        count(doc, telling) / per, count(doc, strong) / per, count(doc, weight) / per,
        np.log1p(count(doc, telling)), np.log1p(count(doc, strong)), largest, hidden / per, np.log1p(hidden),
        count(doc, second) / per, count(doc, telling & beside) / per, np.log1p(count(doc, telling & beside)),
        totals(capital) / lettered, shares[0], totals(mark) / solid, totals(mark[data[mark] == 33]) / solid,
        totals(mark[data[mark] == 63]) / solid, totals(repeated) / solid, shares[1], shares[2], shares[3], shares[4],
        np.log1p(words), lettered / per,
    ]
    return np.stack(out, axis=1) * (words > 0)[:, None]


# --- Boosted trees and calibration


class Trees(NamedTuple):
    """Complete trees of one depth: feature and cut of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees fitted to the logistic loss by its gradients and Hessians, over bins of the features' quantiles."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    inner = (1 << DEPTH) - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.empty(0) for c in x.T]
    # A cut at the largest value would leave one side empty, so the last bin holds what is above all edges.
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else x.astype(int)
    width, d = BINS, x.shape[1]
    offset = np.arange(d) * width
    total, features_, cuts, leaves = np.full(len(x), base), [], [], []
    rows = np.arange(len(x))
    for _ in range(ROUNDS if 0 < y.sum() < len(y) else 0):
        p = _sigmoid(total)
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        split = np.full(inner, width, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (d * width) + offset + binned).ravel()
            gs = np.bincount(at, np.repeat(g, d), many * d * width).reshape(many, d, width).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, d), many * d * width).reshape(many, d, width).cumsum(axis=2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            fits = (hs >= HESSIAN) & (h_all - hs >= HESSIAN)
            value = gs**2 / (hs + PENALTY) + (g_all - gs) ** 2 / (h_all - hs + PENALTY) - g_all**2 / (h_all + PENALTY)
            value = np.where(fits, value, 0.0).reshape(many, -1)
            best = value.argmax(axis=1)
            for k in np.flatnonzero(value[np.arange(many), best] > 1e-12).tolist():
                j, b = divmod(int(best[k]), width)
                if b < len(edges[j]):
                    feature[first + k], cut[first + k], split[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
        sums = [np.bincount(node - inner, v, inner + 1) for v in (g, h)]
        leaf = -RATE * sums[0] / (sums[1] + PENALTY)
        total += leaf[node - inner]
        features_.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    shape = (len(features_), -1) if features_ else (0, inner)
    return Trees(base, np.array(features_, np.int64).reshape(shape), np.array(cuts).reshape(shape), np.array(leaves).reshape(len(leaves), inner + 1))


class Steps(NamedTuple):
    """A rising curve from scores to probabilities, straight between its knots."""

    score: np.ndarray
    share: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.score, self.share)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Steps:
    """The non-decreasing curve with the least squares: neighbours that fall are pooled until none does."""
    if not len(raw):
        return Steps(np.zeros(1), np.zeros(1))
    score, inverse, count = np.unique(raw, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum of labels, rows, first and last score
    for s, n, hits in zip(score.tolist(), count.tolist(), np.bincount(inverse, y).tolist(), strict=True):
        blocks.append([hits, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [(at, b[0] / b[1]) for b in blocks for at in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return Steps(np.array([k[0] for k in knots]), np.array([k[1] for k in knots]))


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees
    curve: Steps

    def score(self, column: pa.Array) -> np.ndarray:
        return self.curve(self.trees.score(features(column, self.lexicon)))


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Trees, Steps]:
    """Trees of all rows, and the curve from scores that trees of the other folds give."""
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        raw[fold == k] = boost(x[fold != k], y[fold != k]).score(x[fold == k])
    return boost(x, y), isotonic(raw, y)


# --- Learning from the labelled rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, counts): rows that hold a word or beginning, by fold and label, summed over some batches."""
    for batch in batches:
        keys, sides = [], []
        side = 2 * batch.column(1).to_numpy() + batch.column(2).to_numpy()
        offsets, data = wd.text_buffers(batch.column(0))
        for words in wd.word_windows(offsets, data, wd.NOT_WORD):
            found = word_keys(data, words)
            # Once for a row: pairs are told apart by a hash of both.
            pair = wd.mix(found ^ wd.mix(words.doc.astype(np.uint64))[:, None] * np.uint64(0x632BE59BD9B4E019)).ravel()
            _, once = np.unique(pair, return_index=True)
            keys.append(found.ravel()[once])
            sides.append(side[words.doc[once // found.shape[1]]])
        if not keys:
            continue
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(inverse * 2 * FOLDS + np.concatenate(sides), minlength=len(key) * 2 * FOLDS)
        counts = counts.reshape(len(key), 2 * FOLDS).astype(np.int64)
        columns = [pa.array(key.view(np.int64)), *[pa.array(c) for c in counts.T]]
        yield pa.RecordBatch.from_arrays(columns, names=["key", *[f"n{j}" for j in range(2 * FOLDS)]])


def _weights(toxic: np.ndarray, clean: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of odds of the entries, and how far their toxic rows are above chance."""
    share = rows[1] / max(1, rows.sum())
    seen = toxic + clean
    weight = np.log((toxic + 0.5) / (rows[1] + 1)) - np.log((clean + 0.5) / (rows[0] + 1))
    return weight, (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1)


def lexicons(keys: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> list[Lexicon]:
    """Lexicons without each fold in turn, then of all rows. `counts` and `rows` go by fold, then label."""
    by = np.argsort(keys)
    keys, counts, rows = keys[by], counts[by].reshape(len(keys), FOLDS, 2), rows.reshape(FOLDS, 2)
    out = []
    for left in range(FOLDS + 1):
        used = np.arange(FOLDS) != left
        clean, toxic = counts[:, used].sum(axis=1).T
        weight, above = _weights(toxic, clean, rows[used].sum(axis=0))
        good = (weight >= TELLING) & (above >= CHANCE) & (toxic >= LEAST)
        out.append(lexicon(keys[good], weight[good]))
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Model:
    """Model from `labels` (key, toxic: 0 or 1) and the texts of those documents.

    Labels without a key or of another value are left out; of several for a key the largest counts, and of
    several texts of a key the one with the smallest hash. If there are more keys than `max_labelled`, those
    with the smallest hash are taken: this bounded sample alone is learned from. Without both kinds of
    labels every text has the same score, the share of toxic rows (0 without any).
    """
    spark = docs.sparkSession
    rated = labels.select(F.col(key).cast("long").alias("_key"), F.col("toxic").cast("int").alias("_toxic")).filter("_toxic in (0, 1)").dropna()
    sample = rated.groupBy("_key").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_key"), "_key").limit(max_labelled)
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.col("text").alias("_text"))
    texts = texts.join(F.broadcast(sample), "_key")  # at most max_labelled
    texts = texts.groupBy("_key", "_toxic").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    fold = F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(FOLDS)).cast("int")
    texts = texts.select("_key", "_text", fold.alias("_fold"), "_toxic").persist()
    try:
        sides = {(r["_fold"], r["_toxic"]): r["n"] for r in texts.groupBy("_fold", "_toxic").agg(F.count("*").alias("n")).collect()}
        rows = np.array([sides.get((k, t), 0) for k in range(FOLDS) for t in (0, 1)], np.float64)
        names = [f"n{j}" for j in range(2 * FOLDS)]
        counted = texts.select("_text", "_fold", "_toxic").mapInArrow(_counted, "key long, " + ", ".join(f"{c} long" for c in names))
        counted = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
        toxic = sum(F.col(c) for c in names[1::2])
        seen = toxic + sum(F.col(c) for c in names[::2])
        share = float(rows[1::2].sum() / max(1.0, rows.sum()))
        above = (toxic - seen * F.lit(share)) / F.sqrt(seen * F.lit(share * (1 - share)) + 1)
        counted = counted.filter(toxic >= LEAST).withColumn("above", above).filter(F.col("above") >= CHANCE)
        entries = counted.orderBy(F.desc("above"), "key").limit(LEXICON).collect()  # LEXICON rows at most
        keys = np.array([r["key"] for r in entries], np.int64).view(np.uint64)
        counts = np.array([[r[c] for c in names] for r in entries], np.float64).reshape(len(entries), 2 * FOLDS)
        known = lexicons(keys, counts, rows)
        shared = spark.sparkContext.broadcast(known)

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in wd.few(batches):
                folds = batch.column(2).to_numpy()
                x = np.zeros((batch.num_rows, len(NAMES)))
                for k in np.unique(folds).tolist():
                    at = np.flatnonzero(folds == k)
                    x[at] = features(batch.column(1).take(pa.array(at)), shared.value[k])
                columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(x.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fold", "toxic", "x"])

        told = texts.mapInArrow(described, "key long, fold int, toxic int, x array<double>")

        def fitted(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("key", kind="stable")
            x = np.array(frame["x"].tolist(), np.float64).reshape(len(frame), len(NAMES))
            trees, curve = fit(x, frame["toxic"].to_numpy(np.float64), frame["fold"].to_numpy())
            parts = [np.array([trees.base]), trees.feature.astype(np.float64), trees.cut, trees.leaf, *curve]
            return pd.DataFrame({"part": range(len(parts)), "numbers": [p.astype(np.float64).tobytes() for p in parts]})

        # One task over at most max_labelled rows of len(NAMES) numbers.
        out = told.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fitted, "part int, numbers binary").collect()
    finally:
        texts.unpersist()
    if not out:
        return Model(known[-1], *fit(np.zeros((0, len(NAMES))), np.zeros(0), np.zeros(0)))
    base, feature, cut, leaf, score, share = (np.frombuffer(bytes(r["numbers"])) for r in sorted(out, key=lambda r: r["part"]))
    inner = (1 << DEPTH) - 1
    trees = Trees(float(base[0]), feature.astype(np.int64).reshape(-1, inner), cut.reshape(-1, inner), leaf.reshape(-1, inner + 1))
    return Model(known[-1], trees, Steps(score, share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `toxicity` (0 to 1) and `toxic` (1 from 0.5 on); columns of these names are replaced.

    Null and empty texts have no features and get the score of such a text. Repeated rows are each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("toxicity", "toxic")]
    df = docs.select(*[docs[c] for c in names])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.few(batches):
            found = shared.value.score(batch.column(at))
            columns = [*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "toxicity", "toxic"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", toxicity double, toxic int")


def held_out(key: str = "doc_id"):
    """Whether the contract keeps a row's label from the model."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.filter(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))
