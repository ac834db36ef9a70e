"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import words as wd
from siftline.session import scratch_path

#: Symbols are UTF-16 units of letters (0 ends a word), four of them a 64-bit code: no two n-grams share one.
ORDER = 4
_UNIT = np.uint64(16)
#: From here on scripts have thousands of letters, two of which say what four of an alphabet do: such a
#: letter has one symbol of history, which keeps the number of distinct n-grams small.
WIDE = 0x2E80
#: Texts whose margins fit the confidence (a bounded sample of the training texts).
CALIBRATION = 4_000
#: One training id in so many is held back from the counts of the model that measures those texts.
ASIDE = 10
COUNTED = "lang string, code long, n long"
#: Confidence under which a prediction is marked as rejected, and how far (in standard deviations of
#: its training texts) a text's cross-entropy may lie above its language's.
REJECT, FAR = 0.5, 6.0


def _mask(order: int) -> np.uint64:
    """Bits of the last `order` symbols."""
    return np.uint64((1 << (16 * order)) - 1)


_LETTERS: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    """Symbols of a text in lower case: letters as they are, 0 for all else."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    units = np.frombuffer(text.lower().encode("utf-16-le", "replace"), np.uint16)
    letter = _LETTERS[0][units]
    for i in np.flatnonzero((units >> 10) == 0x36).tolist():  # first halves of pairs
        point = 0x10000 + ((int(units[i]) - 0xD800) << 10) + int(units[i + 1]) - 0xDC00
        letter[i : i + 2] = chr(point).isalpha()
    return np.where(letter, units, 0).astype(np.uint64)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of every symbol that a model must predict: the letters of each word and the end
    after them, each behind the three symbols before it (one, for letters from `WIDE` on). No history
    goes beyond a word."""
    texts = [w.decode("utf-8", "replace").lower() for w in words]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    joined = " ".join(texts) + " "
    s = _symbols(joined) if texts else np.empty(0, np.uint64)
    if len(s) > len(joined):  # letters of two units
        sizes = np.array([len(t.encode("utf-16-le", "replace")) // 2 + 1 for t in texts], np.int64)
    zero = np.zeros(3, np.uint64)
    before = np.r_[zero[:1], s[:-1]]
    narrow = (s < WIDE) & (before < WIDE)
    second = np.where((before > 0) & narrow, np.r_[zero[:2], s[:-2]][: len(s)], zero[0])
    third = np.where(second > 0, np.r_[zero, s[:-3]][: len(s)], zero[0])
    code = (third << np.uint64(48)) | (second << np.uint64(32)) | (before << _UNIT) | s
    at = np.flatnonzero((s > 0) | (before > 0))
    return np.repeat(np.arange(len(texts)), sizes)[at], code[at]


# --- Counting -----------------------------------------------------------------------------


def _windows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row of each word, its number among the distinct words of a window, those words)."""
    offsets, data = wd.text_buffers(column)
    for words in wd.word_windows(offsets, data):
        _, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        yield words.doc, place, wd.word_texts(data, words.start[first], words.end[first])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language over a task."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], np.int64)
        held: dict[str, list] = {n: [totals[n]] if n in totals else [] for n in names}
        for doc, place, distinct in _windows(batch.column(1)):
            word, code = grams(distinct)
            times = np.bincount(number[doc] * len(distinct) + place, minlength=len(names) * len(distinct)).reshape(len(names), -1)
            codes, at = np.unique(code, return_inverse=True)
            for i, name in enumerate(names):
                n = np.bincount(at, times[i][word], len(codes)).astype(np.int64)
                held[name].append((codes[n > 0], n[n > 0]))
        for name, parts in held.items():
            if parts:
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                totals[name] = codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
    for name, (codes, n) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])


class Tables(NamedTuple):
    """A language's model, for each length of n-grams: sorted codes with their log2 probabilities, and
    sorted histories with log2 of what each leaves for symbols not seen behind it."""

    codes: list[np.ndarray]
    seen: list[np.ndarray]
    behind: list[np.ndarray]
    left: list[np.ndarray]

    def log2(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log2 probability of the last symbol of each code behind the others."""
        if not order:
            return np.full(len(codes), -16.0)
        out, found = _look_up(self.codes[order - 1], self.seen[order - 1], codes)
        miss = np.flatnonzero(~found)
        if len(miss):
            rest, told = _look_up(self.behind[order - 1], self.left[order - 1], codes[miss] >> _UNIT)
            out[miss] = np.where(told, rest, 0.0) + self.log2(codes[miss] & _mask(order - 1), order - 1)
        return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether it is there) for each wanted key of a sorted array."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at].astype(np.float64), keys[at] == wanted


def _kneser_ney(codes: np.ndarray, n: np.ndarray) -> Tables:
    """Interpolated Kneser-Ney over sorted codes: counts for the longest n-grams, numbers of distinct
    symbols before them for the shorter ones, one absolute discount an order, a uniform share of all
    units below."""
    levels = [(codes, n)]
    for order in range(ORDER - 1, 0, -1):  # shorter n-grams: how many symbols stand before each
        levels.insert(0, tuple(np.unique(levels[0][0] & _mask(order), return_counts=True)))
    tables, below = Tables([], [], [], []), None
    for order, (found, count) in enumerate(levels, 1):
        cut = _discount(count)
        behind, first, place = np.unique(found >> _UNIT, return_index=True, return_inverse=True)
        total = np.add.reduceat(count, first).astype(np.float64)
        left = cut * np.diff(np.r_[first, len(found)]) / total
        if below is None:
            shorter = np.full(len(found), 2.0**-16)
        else:
            shorter = below[np.searchsorted(levels[order - 2][0], found & _mask(order - 1))]
        below = np.maximum(count - cut, 0) / total[place] + left[place] * shorter
        tables.codes.append(found)
        tables.seen.append(np.log2(below).astype(np.float32))
        tables.behind.append(behind)
        tables.left.append(np.log2(left).astype(np.float32))
    return tables


def _discount(count: np.ndarray) -> float:
    once, twice = int((count == 1).sum()), int((count == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    codes, n = frame["code"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.int64)
    by = np.argsort(codes)
    tables = _kneser_ney(codes[by], n[by])
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]], **{k: [[x.tobytes() for x in v]] for k, v in tables._asdict().items()}})


# --- Scoring ------------------------------------------------------------------------------


class Model(NamedTuple):
    langs: list[str]
    tables: list[Tables]
    slope: float = 0.0
    bias: float = 0.0
    centre: np.ndarray | None = None  # mean and deviation of cross-entropies by language
    spread: np.ndarray | None = None

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """(codes, languages): bits that each n-gram costs."""
        return np.stack([-t.log2(codes) for t in self.tables], axis=1)

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) bits a symbol, and the number of symbols of each row."""
        total, size = np.zeros((len(column), len(self.langs))), np.zeros(len(column))
        for doc, place, distinct in _windows(column):
            if not len(doc):
                continue
            word, code = grams(distinct)
            codes, at = np.unique(code, return_inverse=True)
            bits = self.bits(codes)[at] if len(codes) else np.zeros((0, len(self.langs)))
            by_word = np.stack([np.bincount(word, bits[:, i], len(distinct)) for i in range(len(self.langs))], axis=1)
            first = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
            rows = doc[first]
            total[rows] += np.add.reduceat(by_word[place], first)
            size[rows] += np.add.reduceat(np.bincount(word, minlength=len(distinct))[place], first)
        return total / np.maximum(size, 1)[:, None], size


def _margins(entropy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, how far the next is behind: bits a symbol, times the root of the length)."""
    order = np.argsort(entropy, axis=1, kind="stable")
    rows = np.arange(len(entropy))
    best = order[:, 0]
    if entropy.shape[1] < 2:
        return best, np.sqrt(size)
    return best, (entropy[rows, order[:, 1]] - entropy[rows, best]) * np.sqrt(size)


def _calibrated(model: Model, told: pd.DataFrame) -> Model:
    """Confidence as a logistic function of the margin (targets drawn in from 0 and 1, as few
    texts are wrong), and the usual cross-entropy of each language."""
    count = len(model.langs)
    centre, spread = np.full(count, 2.5), np.full(count, 1.0)
    if not len(told):
        return model._replace(slope=1.0, bias=0.0, centre=centre, spread=spread)
    right, margin = told["right"].to_numpy(bool), told["margin"].to_numpy()
    good, bad = right.sum(), (~right).sum()
    target = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, bias = 1.0, 0.0
    for _ in range(50):  # Newton steps of two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * margin + bias, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((target - p) * margin).sum() - 1e-3 * slope, (target - p).sum()])
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, bias = slope + np.clip(step[0], -1, 1), bias + np.clip(step[1], -1, 1)
    for i in range(count):
        mine = told["entropy"].to_numpy()[right & (told["best"].to_numpy() == i)]
        if len(mine) > 1:
            centre[i], spread[i] = mine.mean(), max(mine.std(), 0.02)
    return model._replace(slope=max(float(slope), 1e-3), bias=float(bias), centre=centre, spread=spread)


def train(docs: DataFrame) -> Model:
    """Model from (doc_id, lang, text): every text with a language counts.

    Tasks count n-grams of their texts by language; counts are summed by (language, code) and fitted a
    language at a time, over its distinct n-grams of letters. The confidence is fitted on a bounded sample
    of other texts than those of the same language's counts: a tenth of all ids, chosen by hash, is
    measured by a model of the rest, whose counts are then completed.
    """
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(ASIDE)) == 0
    counted = [docs.filter(part).select("lang", "text").mapInArrow(_count, COUNTED).groupBy("lang", "code").agg(F.sum("n").alias("n")) for part in (~aside, aside)]
    at = scratch_path(docs.sparkSession, "grams")
    for name, part in zip(("most", "aside"), counted, strict=True):
        part.write.parquet(f"{at}/{name}")
    most, rest = (docs.sparkSession.read.schema(COUNTED).parquet(f"{at}/{name}") for name in ("most", "aside"))
    model = _fitted(most.unionByName(rest).groupBy("lang", "code").agg(F.sum("n").alias("n")))
    without = _fitted(most)
    if not without.langs:
        return _calibrated(model, pd.DataFrame())
    shared = docs.sparkSession.sparkContext.broadcast(without)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, size = shared.value.entropies(batch.column(1))
            best, margin = _margins(entropy, size)
            own = entropy[np.arange(len(best)), best]
            right = np.array([shared.value.langs[b] == x for b, x in zip(best, batch.column(0).to_pylist(), strict=True)], bool)
            ok = size > 0
            columns = [pa.array(best[ok].astype(np.int32)), pa.array(margin[ok]), pa.array(own[ok]), pa.array(right[ok])]
            yield pa.RecordBatch.from_arrays(columns, names=["best", "margin", "entropy", "right"])

    sample = docs.filter(aside).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text")).limit(CALIBRATION)
    told = sample.select("lang", "text").mapInArrow(measure, "best int, margin double, entropy double, right boolean").toPandas()
    told["best"] = told["best"].map({i: model.langs.index(name) for i, name in enumerate(without.langs)})
    return _calibrated(model, told.sort_values(["best", "margin", "entropy"]))


def _fitted(counts: DataFrame) -> Model:
    """Model of counted n-grams, not calibrated."""
    kinds = "lang string, codes array<binary>, seen array<binary>, behind array<binary>, left array<binary>"
    rows = sorted(counts.groupBy("lang").applyInPandas(_fit, kinds).collect(), key=lambda r: r.lang)
    types = (np.uint64, np.float32, np.uint64, np.float32)
    tables = [Tables(*[[np.frombuffer(bytes(x), t) for x in part] for part, t in zip(r[1:], types, strict=True)]) for r in rows]
    return Model([r.lang for r in rows], tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score, cross_entropy, rejected (columns of such names are replaced).

    The language with the fewest bits a symbol is predicted, ties going to the first by name;
    `score` is its calibrated confidence. `und` with score 0 where there is no letter, no text or no
    language was learnt. `rejected` marks predictions of low confidence or of a text far from
    all that its language's model has seen. Only `text` is read; repeated rows are each identified.
    """
    added = ("lang_pred", "score", "cross_entropy", "rejected")
    names = [c for c in docs.columns if c not in added]
    df = docs.select(*names)
    at = names.index("text")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m.langs:
                entropy, size = m.entropies(batch.column(at))
                best, margin = _margins(entropy, size)
                known = size > 0
                score = np.where(known, 1 / (1 + np.exp(-np.clip(m.slope * margin + m.bias, -30, 30))), 0.0)
                own = entropy[np.arange(len(best)), best]
                out = ~known | (score < REJECT) | (own > m.centre[best] + FAR * m.spread[best])
                lang = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            else:
                n = batch.num_rows
                lang, score, own, out = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
            columns = [pa.array(lang, pa.string()), pa.array(score), pa.array(own), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *added])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, schema + ", lang_pred string, score double, cross_entropy double, rejected boolean")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    found = identify(docs.select("doc_id", "text", held.alias("held_out")), train(docs.filter(~held)))
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
