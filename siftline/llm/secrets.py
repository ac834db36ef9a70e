"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import scratch_path

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs: a match starts where a run does
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16
#: Words without which `ASSIGN` cannot match.
_HINT = ("passw", "secret", "token", "api")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")

#: Strings that the battery looks at, and the lengths at which its bands begin. A run starts where no
#: key character stands before it, so after '=' too; '=' is padding only where no key character follows.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?!=*[A-Za-z0-9+/_-]))?")
BANDS = (20, 32, 64)
#: Expected share of false discoveries.
RATE = 0.05
#: Decoys under which a stratum's null is that of wider strata.
FEWEST = 400
#: Characters, and strings, that are cut into decoys at a time.
DECOY_CHARS, DECOY_ROWS = 1 << 20, 1 << 13

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings by alphabet, from narrow to wide; a string's is the first that holds all its characters.
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("letters", _LOWER + _UPPER),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _DIGITS + _UPPER + _LOWER + "+/_-"),
)
_INDEX = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]
#: Place of each ASCII character in each alphabet, -1 for others.
_PLACE = np.array([[own.get(chr(c), -1) for c in range(128)] + [-1] for own in _INDEX], np.int8)
#: Bins of the battery's result: 8 for each factor e of the combined p-value.
BINS = 256


def encoding(text: str) -> int:
    """Place in `ENCODINGS` of the narrowest alphabet of a string."""
    seen = set(text)
    return next(i for i, own in enumerate(_INDEX) if seen <= own.keys())


def _upper_tail(z: float) -> float:
    """Upper tail of the standard normal, to about 1e-7 of itself far out as well."""
    if z < -8:
        return 1.0
    from math import erfc, sqrt

    return 0.5 * erfc(z / sqrt(2))


def battery(text: str, kind: int) -> float:
    """Fisher's combined p-value of a string being uniform random in its encoding.

    Chi-squared of the symbol counts (by the cube-root normal form), runs above and below the middle
    of the alphabet, and the serial correlation of neighbours, both two-sided.
    """
    own = _INDEX[kind]
    x = np.fromiter(map(own.__getitem__, text), np.float64, len(text))
    n, k = len(x), len(own)
    counts = np.bincount(x.astype(np.int64), minlength=k)
    chi, df = float((counts.astype(np.float64) ** 2).sum() * k / n - n), k - 1
    uniform = _upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    high = x >= k / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / var**0.5)
    else:
        runs = 2.0 ** (1 - n)
    centred = x - x.mean()
    spread = float((centred**2).sum())
    serial = 2 * _upper_tail(abs(float((centred[1:] * centred[:-1]).sum()) / spread + 1 / n) * n**0.5) if spread else 0.0
    half = -sum(np.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return float(np.exp(-half) * (1 + half + half * half / 2))


def _bin(p: float) -> int:
    return min(BINS - 1, int(-8 * np.log(max(p, 1e-300))))


def _band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


def _stratum(kind: int, length: int) -> int:
    return kind * len(BANDS) + _band(length)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINT):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_LOGS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
#: -log of the two-sided tail of the standard normal.
_SIDES = np.linspace(0, 12, 120_001)
_TAILS = np.array([-np.log(max(2 * _upper_tail(z), 1e-300)) for z in _SIDES.tolist()])


def _logs(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """-log p of `battery` by the sum of squared symbol counts, and by (high symbols, runs)."""
    if (kind, n) not in _LOGS:
        k = len(_INDEX[kind])
        df = k - 1
        z = [((max(s * k / n - n, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5 for s in range(n * n + 1)]
        runs = np.full((n + 1, n + 1), 2.0 ** (1 - n))
        for a in range(1, n):
            mean = 2 * a * (n - a) / n + 1
            var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
            runs[a] = [2 * _upper_tail(abs(r - mean) / var**0.5) for r in range(n + 1)]
        uniform = np.array([_upper_tail(x) for x in z])
        _LOGS[kind, n] = -np.log(np.maximum(uniform, 1e-300)), -np.log(np.maximum(runs, 1e-300))
    return _LOGS[kind, n]


def _bins(places: np.ndarray, kind: int) -> np.ndarray:
    """Bins of the battery's results for strings of one length, a row of places in the alphabet each."""
    (m, n), k = places.shape, len(_INDEX[kind])
    uniform, runs = _logs(kind, n)
    counts = np.bincount((places + (np.arange(m, dtype=np.int32) * k)[:, None]).ravel(), minlength=m * k).reshape(m, k)
    high = places >= k / 2
    half = uniform[np.einsum("ij,ij->i", counts, counts)]
    half = half + runs[high.sum(axis=1), 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)]
    x = places.astype(np.float32)  # sums of whole numbers below 2 ** 24
    total = x.sum(axis=1).astype(np.float64)
    spread = np.einsum("ij,ij->i", x, x) - total * total / n
    mean = total / n
    near = np.einsum("ij,ij->i", x[:, 1:], x[:, :-1]) - mean * (2 * total - x[:, 0] - x[:, -1]) + (n - 1) * mean * mean
    side = np.abs(near / np.where(spread > 0, spread, 1) + 1 / n) * n**0.5
    half += np.where(spread > 0, np.interp(side, _SIDES, _TAILS), -np.log(1e-300))
    return np.clip(8 * (half - np.log(1 + half + half * half / 2)), 0, BINS - 1).astype(np.int64)


def _decoys(texts: list[str], spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """(stratum, bin) counts of strings made of the characters of natural text.

    In every encoding and band the whole of each text is cut into strings. Spans are cut out first, and
    characters outside the alphabet are left out, as if the text had been written in it.
    """
    out = np.zeros(len(ENCODINGS) * len(BANDS) * BINS, np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    points = np.minimum(points, 128).astype(np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for end, text, mine in zip(ends.tolist(), texts, spans, strict=True):
        for a, b in mine:
            points[end - len(text) + a : end - len(text) + b] = 128
    for kind in range(len(ENCODINGS)):
        places = _PLACE[kind][points]
        at = np.flatnonzero(places >= 0)
        places = places[at].astype(np.int32)
        upto = np.searchsorted(at, ends)
        sizes = np.diff(upto, prepend=0)
        for n in BANDS:
            pieces = sizes // n
            ahead = np.cumsum(pieces) - pieces
            first = np.repeat(upto - sizes - n * ahead, pieces) + n * np.arange(int(pieces.sum()))
            for i in range(0, len(first), DECOY_ROWS):
                found = _bins(places[first[i : i + DECOY_ROWS, None] + np.arange(n)], kind)
                stratum = _stratum(kind, n)
                out[stratum * BINS : (stratum + 1) * BINS] += np.bincount(found, minlength=BINS)
    return out.reshape(-1, BINS)


_FIND = pa.schema(
    [("doc_id", pa.int64()), ("base", pa.list_(pa.list_(pa.int64()))), ("tried", pa.list_(pa.list_(pa.int64()))), ("decoys", pa.list_(pa.list_(pa.int64())))]
)
_FIND_SCHEMA = "doc_id long, base array<array<long>>, tried array<array<long>>, decoys array<array<long>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each text holds; the first row of a batch has the decoys of all, as (stratum, bin, count)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        base, tried, waiting, spans, size = [], [], [], [], 0
        total = np.zeros((len(ENCODINGS) * len(BANDS), BINS), np.int64)
        for text in batch.column(1).to_pylist():
            text = text or ""
            fixed = base_spans(text)
            found = [m.span() for m in CANDIDATE.finditer(text)]
            mine = []
            for start, end in found:
                body = text[start:end].rstrip("=")
                kind = encoding(body)
                if not any(a < end and start < b for a, _, b in fixed):
                    mine.append((start, end, _stratum(kind, len(body)), _bin(battery(body, kind))))
            base.append(fixed)
            tried.append(mine)
            waiting.append(text)
            spans.append(found + [(a, b) for a, _, b in fixed])
            size += len(text)
            if size >= DECOY_CHARS:
                total += _decoys(waiting, spans)
                waiting, spans, size = [], [], 0
        total += _decoys(waiting, spans)
        decoys = [[(s, b, total[s, b]) for s, b in np.argwhere(total).tolist()]] + [[]] * (batch.num_rows - 1)
        columns = [batch.column(0), base, tried, decoys]
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _FIND, strict=True)], schema=_FIND
        )


class Tally(NamedTuple):
    tried: np.ndarray
    decoys: np.ndarray


def _null(decoys: np.ndarray) -> np.ndarray:
    """Decoys that stand for each stratum: its own, or those of wider strata where they are few.

    First the shorter bands of the encoding join (shorter strings look more random, so fewer are
    accepted), then the encodings whose alphabets hold its own, then all strata.
    """
    out = decoys.copy()
    wide, every = decoys.reshape(len(ENCODINGS), len(BANDS), BINS), decoys.sum(axis=0)
    for kind, own in enumerate(_INDEX):
        holds = [i for i, x in enumerate(_INDEX) if own.keys() <= x.keys()]
        for band in range(len(BANDS)):
            shorter = wide[:, : band + 1].sum(axis=1)
            pools = (wide[kind, band], shorter[kind], shorter[holds].sum(axis=0))
            out[kind * len(BANDS) + band] = next((p for p in pools if p.sum() >= FEWEST), every)
    return out


def limits(tally: Tally, rate: float = RATE) -> np.ndarray:
    """Largest accepted bin of each stratum; -1 where nothing is accepted.

    A string's p-value under natural text is the share of its stratum's decoys that look as random
    (one added on both sides); see `_null` for strata with few. Within a stratum - an encoding and a
    band of lengths, as power grows with length - the Benjamini-Hochberg rule accepts the most strings
    whose expected share of false ones is `rate`. Where a table has too little natural text for any
    p-value to reach `rate`, strings that the battery does not reject as random at `rate` are accepted.
    """
    null = _null(tally.decoys)
    share = (1 + np.cumsum(null, axis=1)) / (1 + null.sum(axis=1, keepdims=True))
    found = np.cumsum(tally.tried, axis=1)
    good = (found > 0) & (share * found[:, -1:] <= rate * found)
    most = np.where(good.any(axis=1), good.shape[1] - 1 - np.argmax(good[:, ::-1], axis=1), -1)
    return np.where(rate * (1 + null.sum(axis=1)) < 1, _bin(rate), most)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every row's spans as structs (start, kind, end), sorted; kinds as in `KINDS`.

    Fixed patterns give kinds 0 to 2. Other runs of 20 or more key characters get the battery's
    p-value in their narrowest encoding; those that look more random than natural text does, at a
    false-discovery rate of `RATE` for each encoding and band of lengths, are of kind 3. Natural text is
    represented by decoys cut from the whole of every text in every encoding. Offsets count code points, ends are exclusive. A null or
    empty text has no spans; repeated rows are each scanned (and each counted); other columns are ignored.

    Texts are read once; what was found is written, counted by (stratum, bin) - a table of fixed size
    - and filtered by the limits.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "spans")
    docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_find, _FIND_SCHEMA).write.parquet(at)
    found = spark.read.parquet(at)
    count = len(ENCODINGS) * len(BANDS)
    tally = Tally(np.zeros((count, BINS), np.int64), np.zeros((count, BINS), np.int64))
    pairs = {
        "tried": found.select(F.explode("tried").alias("x")).select(F.col("x")[2].alias("s"), F.col("x")[3].alias("b"), F.lit(1).alias("n")),
        "decoys": found.select(F.explode("decoys").alias("x")).select(
            F.col("x")[0].alias("s"), F.col("x")[1].alias("b"), F.col("x")[2].alias("n")
        ),
    }
    for name, rows in pairs.items():
        for r in rows.groupBy("s", "b").agg(F.sum("n").alias("n")).collect():  # strata times bins at most
            getattr(tally, name)[r.s, r.b] = r.n
    most = F.array(*[F.lit(int(x)) for x in limits(tally)])
    passed = F.filter("tried", lambda t: t[3] <= F.get(most, t[2].cast("int")))
    spans = F.concat(
        F.transform("base", lambda b: F.struct(b[0].alias("start"), b[1].cast("int").alias("kind"), b[2].alias("end"))),
        F.transform(passed, lambda t: F.struct(t[0].alias("start"), F.lit(3).alias("kind"), t[1].alias("end"))),
    )
    return found.select("doc_id", F.sort_array(spans).alias("spans"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
