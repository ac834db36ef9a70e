"""Hidden Markov language model over the words of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import words as wd
from siftline.session import scratch_path

STATES = 8
#: Baum-Welch rounds, each over the whole corpus.
ROUNDS = 5
#: A word with this share of the training tokens has emissions of its own (so at most 1 / SHARE
#: words have); the others share those of their ending, and split its mass by their base probability.
SHARE, LEAST = 4e-6, 3
ENDINGS = 4096
#: Weight of a state's own emissions; the rest is the base distribution.
TRUST = 0.9
PRIOR = 0.1
#: Tokens of a block of documents, and words that one range of hashes holds, about.
BLOCK_TOKENS, RANGE_WORDS = 1 << 20, 1_000_000
#: Tokens that one training sequence holds at most; scoring has no such bound.
TRAIN_TOKENS = 1 << 16
END = np.uint64(0x5BD1E995C0FFEE11)

_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.binary()), ("lengths", pa.binary()),
        ("ids", pa.binary()), ("vocabulary", pa.binary()), ("endings", pa.binary()), ("counts", pa.binary()),
        ("words", pa.int64()), ("train_tokens", pa.int64()),
    ]
)
BLOCK_SCHEMA = (
    "block long, docs array<long>, held binary, lengths binary, ids binary, vocabulary binary, endings binary,"
    " counts binary, words long, train_tokens long"
)


# --- Blocks: documents as numbers of a vocabulary of their own ----------------------------------


def _endings(data: np.ndarray, words: wd.Words) -> np.ndarray:
    """A class for the last three bytes of each word."""
    out = np.zeros(len(words.end), np.uint64)
    for j in range(1, 4):
        at = words.end - j
        byte = np.where(at >= words.start, wd._LOWER[data[np.maximum(at, 0)]], 0).astype(np.uint64)
        out = out * np.uint64(257) + byte
    return (wd.mix(out) % np.uint64(ENDINGS)).astype(np.uint16)


def _block(number: int, docs: list, held: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, endings: np.ndarray) -> pa.RecordBatch:
    """One row: texts with an end token each."""
    ends = np.cumsum(lengths)
    hashes = np.insert(hashes, ends, END)
    endings = np.insert(endings, ends, 0)
    lengths = (lengths + 1).astype(np.int32)
    vocabulary, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    train = np.repeat(~held, lengths)
    counts = np.bincount(ids[train], minlength=len(vocabulary)).astype(np.int32)
    values = [
        number, docs, held.tobytes(), lengths.tobytes(), ids.astype(np.int32).tobytes(), vocabulary.tobytes(),
        endings[first].tobytes(), counts.tobytes(), len(vocabulary), int(counts.sum()),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents, about `BLOCK_TOKENS` in a block (one longer document is a block)."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        keys, flags = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
        offsets, data = wd.text_buffers(batch.column(2))
        first, held, waiting = 0, [], 0  # the first row of the open block, its words, their number

        def close(upto: int, parts: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            doc, hashes, endings = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
            lengths = np.bincount(doc - first, minlength=upto - first)  # noqa: B023
            return _block(number, keys[first:upto], flags[first:upto], lengths, hashes.astype(np.uint64), endings.astype(np.uint16))  # noqa: B023

        for words in wd.word_windows(offsets, data):
            if not len(words.doc):
                continue
            held.append((words.doc, words.hash, _endings(data, words)))
            waiting += len(words.doc)
            last = int(words.doc[-1])
            if waiting >= BLOCK_TOKENS and last > first:  # the last row may go on in the next window
                whole = [tuple(x[d < last] for x in (d, h, e)) for d, h, e in held]
                rest = [tuple(x[d >= last] for x in (d, h, e)) for d, h, e in held[-1:]]
                older = [tuple(x[d >= last] for x in (d, h, e)) for d, h, e in held[:-1]]
                yield close(last, whole)
                held = [p for p in older + rest if len(p[0])]
                first, waiting = last, sum(len(p[0]) for p in held)
        if first < len(keys):
            yield close(len(keys), held)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Blocks one by one: each is large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


# --- Counts of words over the corpus ------------------------------------------------------------


_SLICE = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("vocabulary", pa.binary()), ("endings", pa.binary()), ("counts", pa.binary())])


def _slices(ranges: int):
    """A block's vocabulary in one row for each range of hashes; it is sorted by them."""
    width = -(-(1 << 64) // ranges)
    edges = np.array([min(i * width, (1 << 64) - 1) for i in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words = np.frombuffer(row["vocabulary"], np.uint64)
                cuts = np.r_[0, np.searchsorted(words, edges), len(words)]
                parts = [
                    (i, row["block"], row["vocabulary"][8 * a : 8 * b], row["endings"][2 * a : 2 * b], row["counts"][4 * a : 4 * b])
                    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    if b > a
                ]
                columns = list(zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SLICE, strict=True)], schema=_SLICE)

    return run


_COUNTED = "block long, range int, counts binary, types long, frequent array<long>, often array<long>, rare binary"


def _count(least: float):
    """Corpus counts of the words of a range, handed back to each block in its own order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for frame in frames:
            for at, block, words, endings, counts in frame.itertuples(index=False):
                held.setdefault(at, []).append(
                    (block, np.frombuffer(words, np.uint64), np.frombuffer(endings, np.uint16), np.frombuffer(counts, np.int32))
                )
        for at in list(held):
            parts = held.pop(at)
            every = np.concatenate([p[1] for p in parts])
            unique, first, place = np.unique(every, return_index=True, return_inverse=True)
            total = np.bincount(place, np.concatenate([p[3] for p in parts]), len(unique)).astype(np.int64)
            ending = np.concatenate([p[2] for p in parts])[first]
            often = total >= least
            few = (total > 0) & ~often
            # Tokens and types that share the emissions of an ending.
            rare = np.stack([np.bincount(ending[few], total[few], ENDINGS), np.bincount(ending[few], minlength=ENDINGS)])
            ends = np.cumsum([len(p[1]) for p in parts])[:-1]
            mine = [x.tobytes() for x in np.split(total[place], ends)]
            blank = [None] * len(parts)
            yield pd.DataFrame(
                {
                    "block": pd.array([p[0] for p in parts] + [None], "Int64"), "range": at, "counts": [*mine, None],
                    "types": pd.array([*blank, int((total > 0).sum())], "Int64"),
                    "frequent": [*blank, unique[often].astype(np.int64).tolist()], "often": [*blank, total[often].tolist()],
                    "rare": [*blank, rare.astype(np.float64).tobytes()],
                }
            )

    return run


class Lexicon(NamedTuple):
    """Classes of words: frequent words one by one, then endings, then all unknown words."""

    frequent: np.ndarray  # sorted hashes
    base: np.ndarray  # base probability of each class
    tokens: int
    types: int

    @property
    def total(self) -> float:
        return self.tokens + PRIOR * (self.types + 1)

    def classes(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Class of each known word."""
        out = len(self.frequent) + endings.astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == words, at, out)
        return out

    def word_base(self, counts: np.ndarray) -> np.ndarray:
        """Base probability of words with such training counts."""
        return (counts + PRIOR) / self.total


# --- The model ------------------------------------------------------------------------------------


class Hmm(NamedTuple):
    start: np.ndarray
    step: np.ndarray
    own: np.ndarray  # (classes, states): emissions that the states have learnt

    def emissions(self, base: np.ndarray) -> np.ndarray:
        """(classes, states): no class has probability 0 anywhere."""
        return TRUST * self.own + (1 - TRUST) * base[:, None]


def random_model(base: np.ndarray, seed: int = 11) -> Hmm:
    rng = np.random.default_rng(seed)
    own = base[:, None] * rng.gamma(1.0, 1.0, (len(base), STATES))
    step = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Hmm(np.full(STATES, 1 / STATES), step, own / own.sum(axis=0))


def _sorted(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, their first tokens, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    reach = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    return order, first, reach


def log_likelihood(model: Hmm, emit: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of every sequence by the scaled forward recursion, all side by side."""
    order, first, reach = _sorted(lengths)
    total = np.zeros(len(lengths))
    state = np.tile(model.start, (len(lengths), 1))
    for t, n in enumerate(reach.tolist()):
        state = state[:n] if not t else state[:n] @ model.step
        state = state * emit[classes[first[:n] + t]]
        scale = state.sum(axis=1)
        total[:n] += np.log10(scale)
        state /= scale[:, None]
    out = np.empty(len(lengths))
    out[order] = total
    return out


class Counts(NamedTuple):
    """Expected counts of a Baum-Welch round."""

    start: np.ndarray
    step: np.ndarray
    own: np.ndarray

    def model(self) -> Hmm:
        start = self.start + 1e-3
        step = self.step + 1e-3
        own = self.own / np.maximum(self.own.sum(axis=0), 1e-9)
        return Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), own)


def expected_counts(model: Hmm, emit: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> Counts:
    """One round of forward and backward recursions over sequences of at most `TRAIN_TOKENS`."""
    order, first, reach = _sorted(lengths)
    # Tokens by step, so that those of a step stand side by side; `many` reach it, from place `begin`.
    many = reach.tolist()
    begin = np.concatenate([[0], np.cumsum(reach)])
    step, which = model.step.astype(np.float32), np.repeat(np.arange(len(reach)), reach)
    classes = classes[first[np.arange(len(which)) - begin[which]] + which]
    seen = emit.astype(np.float32)[classes]
    forward, scales = np.empty((len(classes), STATES), np.float32), np.empty((len(classes), 1), np.float32)
    state, at = model.start.astype(np.float32), 0
    for n in many:
        here, scale = forward[at : at + n], scales[at : at + n]
        np.multiply(state if not at else state[:n] @ step, seen[at : at + n], out=here)
        np.add.reduce(here, axis=1, keepdims=True, out=scale)
        here /= scale
        state, at = here, at + n
    seen /= scales
    back = np.ones((many[0] if many else 0, STATES), np.float32)
    steps, after = np.zeros((STATES, STATES)), 0
    turned = np.ascontiguousarray(step.T)
    for n in reversed(many):
        at -= n
        if after:
            ahead = seen[at + n : at + n + after]
            ahead *= back[:after]
            np.matmul(ahead, turned, out=back[:after])
            steps += forward[at : at + after].T @ ahead
            forward[at : at + after] *= back[:after]
        after = n
    starts = forward[: many[0]].sum(axis=0, dtype=np.float64) if many else np.zeros(STATES)
    own = np.stack([np.bincount(classes, forward[:, k], len(emit)) for k in range(STATES)], axis=1)
    return Counts(starts, steps * model.step, own)


def _training(row: dict, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Classes and lengths of a block's training texts, cut where they are very long."""
    lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
    held = np.frombuffer(row["held"], bool)
    words = lexicon.classes(np.frombuffer(row["vocabulary"], np.uint64), np.frombuffer(row["endings"], np.uint16))
    classes = words[np.frombuffer(row["ids"], np.int32)[np.repeat(~held, lengths)]]
    lengths = lengths[~held]
    if (lengths > TRAIN_TOKENS).any():
        lengths = np.array([min(TRAIN_TOKENS, n - a) for n in lengths.tolist() for a in range(0, n, TRAIN_TOKENS)])
    return classes, lengths


#: Numbers that travel in one row of a task's expected counts.
_PART = 1 << 14


def _expect(lexicon, model):
    """Expected counts of a task's blocks, in rows of `_PART` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, now = lexicon.value, model.value
        emit, total = now.emissions(lex.base), None
        for batch in batches:
            for row in _rows(batch):
                classes, lengths = _training(row, lex)
                if len(lengths):
                    found = expected_counts(now, emit, classes, lengths)
                    total = found if total is None else Counts(*[a + b for a, b in zip(total, found, strict=True)])
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total]).astype(np.float32)
            parts = [flat[i : i + _PART].tobytes() for i in range(0, len(flat), _PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "x"])

    return run


def _sum_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by part; a partition holds few parts, however many rows they have."""
    totals: dict[int, np.ndarray] = {}
    for frame in frames:
        for at, raw in zip(frame["part"], frame["x"], strict=True):
            x = np.frombuffer(raw, np.float32).astype(np.float64)
            totals[at] = totals[at] + x if at in totals else x
    yield pd.DataFrame({"part": list(totals), "x": [t.tobytes() for t in totals.values()]}).astype({"part": "int32"})


def _round(blocks: DataFrame, lexicon, model: Hmm) -> Hmm:
    """One Baum-Welch round over all training texts."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = ["held", "lengths", "ids", "vocabulary", "endings"]
    rows = blocks.select(*columns).mapInArrow(_expect(lexicon, shared), "part int, x binary")
    found = rows.repartition("part").mapInPandas(_sum_parts, "part int, x binary").collect()
    shared.unpersist()
    if not found:
        return model
    flat = np.concatenate([np.frombuffer(bytes(r.x), np.float64) for r in sorted(found, key=lambda r: r.part)])
    shapes = [x.shape for x in model]
    cuts = np.cumsum([np.prod(s, dtype=int) for s in shapes])[:-1]
    return Counts(*[x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes, strict=True)]).model()


# --- The operator -----------------------------------------------------------------------------


def _score(lexicon, model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, now = lexicon.value, model.value
        emit = now.emissions(lex.base)
        for frame in frames:
            for row in frame.to_dict("records"):
                parts = sorted(zip(row["ranges"], row["parts"], strict=True))
                counts = np.concatenate([np.frombuffer(x, np.int64) for _, x in parts])
                words = lex.classes(np.frombuffer(row["vocabulary"], np.uint64), np.frombuffer(row["endings"], np.uint16))
                words = np.where(counts > 0, words, len(lex.base) - 1)
                ids = np.frombuffer(row["ids"], np.int32)
                lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                at = np.cumsum(lengths) - lengths
                base = np.log10(lex.word_base(counts))
                inside = base - np.log10(lex.base[words])  # a word within its class
                score = log_likelihood(now, emit, words[ids], lengths) + np.add.reduceat(inside[ids], at)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["docs"]], "Int64"),
                        "held_out": np.frombuffer(row["held"], bool), "n_tokens": lengths,
                        "n_known": np.add.reduceat((counts > 0)[ids].astype(np.int64), at), "train_tokens": lex.tokens,
                        "base_score": np.add.reduceat(base[ids], at), "score": score,
                    }
                )

    return run


def hmm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", tenth: int = 10) -> DataFrame:
    """Score all texts with a model learnt from those whose crc32(key as text) mod `tenth` is not 0.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are words cut at
    white space, A-Z in lower case, and an end. `base_score` sums log10 of the smoothed shares of the
    tokens; `score` is the log10 probability under a hidden Markov model of `STATES` states whose
    emissions mix what a state has learnt with those shares, so every text has one. A null or empty
    text is an end token alone, a null key counts as empty text; repeated rows are each used and scored;
    other columns are ignored. Without training text all states emit the base distribution.

    Texts become blocks of word numbers once, in a written table. Words are counted by ranges of
    their hashes, each block gets its counts back, and every Baum-Welch round reads the blocks and
    sums expected counts of a bounded number of classes. Scores are exact sums over state paths.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.col(key).cast("long"), (crc % tenth == 0).alias("held"), F.col(text).alias("text"))
    at = scratch_path(spark, "blocks")
    rows.mapInArrow(_blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(at)
    blocks = spark.read.parquet(at)
    sums = blocks.agg(F.sum("words").alias("words"), F.sum("train_tokens").alias("tokens")).first()
    tokens, ranges = int(sums.tokens or 0), max(16, -(-int(sums.words or 0) // RANGE_WORDS))
    sliced = blocks.select("block", "vocabulary", "endings", "counts").mapInArrow(
        _slices(ranges), "range int, block long, vocabulary binary, endings binary, counts binary"
    )
    least = max(LEAST, SHARE * tokens)
    at = scratch_path(spark, "counts")
    sliced.repartition(ranges, "range").mapInPandas(_count(least), _COUNTED).write.parquet(at)
    counted = spark.read.parquet(at)
    lexicon = spark.sparkContext.broadcast(_lexicon(counted.filter("block is null"), tokens))
    model = random_model(lexicon.value.base)
    for _ in range(ROUNDS if tokens else 0):
        model = _round(blocks, lexicon, model)
    shared = spark.sparkContext.broadcast(model)
    mine = counted.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("range", "counts")).alias("p"))
    mine = mine.select("block", F.col("p.range").alias("ranges"), F.col("p.counts").alias("parts"))
    columns = ["block", "docs", "held", "lengths", "ids", "vocabulary", "endings"]
    return blocks.select(*columns).join(mine, "block").drop("block").mapInPandas(
        _score(lexicon, shared),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _lexicon(told: DataFrame, tokens: int) -> Lexicon:
    """At most 1 / `SHARE` frequent words and `ENDINGS` sums come to the driver."""
    words = told.select(F.explode(F.arrays_zip("frequent", "often")).alias("x")).select("x.*").toPandas()
    frequent = words["frequent"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(frequent)
    frequent, often = frequent[by], words["often"].to_numpy(np.float64)[by]
    rare, types = np.zeros((2, ENDINGS)), 0
    for row in told.select("types", "rare").toLocalIterator():
        rare += np.frombuffer(bytes(row.rare), np.float64).reshape(2, ENDINGS)
        types += row.types
    total = tokens + PRIOR * (types + 1)
    base = np.concatenate([(often + PRIOR) / total, (rare[0] + PRIOR * rare[1]) / total, [PRIOR / total]])
    return Lexicon(frequent, base, tokens, types)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_scores(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
