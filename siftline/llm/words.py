"""Word hashes of whole Arrow string columns, computed with numpy inside a task.

The bytes of a batch are read in windows cut at word ends, so memory follows the window,
not the text: a text longer than a window is read in several. Hashes are 64-bit
polynomials over the bytes with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

WINDOW_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.zeros(256, bool)  # all ASCII but digits and letters
NOT_WORD[:128] = True
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for windows of the usual width."""
    if n > WINDOW_BYTES + 1:  # a single word longer than that
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if "up" not in _TABLES:
        _TABLES["up"] = _powers(_BASE, WINDOW_BYTES + 1)
        _TABLES["down"] = _powers(_INVERSE, WINDOW_BYTES + 1)
    return _TABLES["up"], _TABLES["down"]


class Words(NamedTuple):
    """Words of a window, in reading order; `start` and `end` index `data`."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


#: Rows that a task handles at a time.
FEW = 1_000


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            yield batch.slice(at, FEW)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is run inside: neither the executor's JVM nor its
    Python workers then hold more wide rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and UTF-8 bytes of a string column; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        column, wide = column.cast(pa.string()), np.int32
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
    return at.astype(np.int64), np.frombuffer(data if data is not None else b"", np.uint8)


def word_windows(
    offsets: np.ndarray, data: np.ndarray, separator: np.ndarray = SPACE
) -> Iterator[Words]:
    """Words of all rows. `separator` flags the byte values between words."""
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = _cut(offsets, data, separator, at, stop)
        yield _words(offsets, data, separator, at, end)
        at = end


def _cut(offsets, data, separator, at: int, stop: int) -> int:
    """End of a window: no word goes across it."""
    end = at + WINDOW_BYTES
    if end >= stop:
        return stop
    row = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
    if row > at:
        return row
    gaps = np.flatnonzero(separator[data[at:end]])
    if len(gaps):
        return at + int(gaps[-1]) + 1
    while end < stop:  # one word wider than a window
        gaps = np.flatnonzero(separator[data[end : end + WINDOW_BYTES]])
        if len(gaps):
            return min(end + int(gaps[0]), int(offsets[np.searchsorted(offsets, at, side="right")]))
        end += WINDOW_BYTES
    return int(offsets[np.searchsorted(offsets, at, side="right")])


def _words(offsets, data, separator, at: int, end: int) -> Words:
    part = data[at:end]
    inside = ~separator[part]
    rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
    before = np.zeros(len(part), bool)
    before[1:] = inside[:-1]
    before[rows] = False
    after = np.zeros(len(part), bool)
    after[:-1] = inside[1:]
    after[rows[rows > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    up, down = _tables(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * down[start])
    doc = np.searchsorted(offsets, start + at, side="right") - 1
    return Words(doc, start + at, stop + at, hashes)


def word_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The bytes of some words as they stand."""
    raw = memoryview(np.ascontiguousarray(data))
    return [bytes(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _hash(data: np.ndarray, words: Words) -> np.ndarray:
    return words.hash


def doc_hashes(
    column: pa.Array, separator: np.ndarray = SPACE, of: Callable[[np.ndarray, Words], np.ndarray] = _hash
) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for every row of a batch, empty ones included.

    `of` makes something else of a window's words: an array with a row for each.
    """
    offsets, data = text_buffers(column)
    row, held = 0, []
    for words in word_windows(offsets, data, separator):
        if not len(words.doc):
            continue
        cuts = np.flatnonzero(np.diff(words.doc)) + 1
        for part, doc in zip(
            np.split(of(data, words), cuts), words.doc[np.r_[0, cuts]].tolist(), strict=True
        ):
            while row < doc:
                yield row, _joined(held)
                row, held = row + 1, []
            held.append(part)
    while row < len(column):
        yield row, _joined(held)
        row, held = row + 1, []


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def beginnings(data: np.ndarray, words: Words, width: int) -> np.ndarray:
    """Hashes of the first `width` bytes of each word, A-Z in lower case."""
    out = np.full(len(words.start), width, np.uint64)
    for j in range(width):
        at = words.start + j
        byte = np.where(at < words.end, _LOWER[data[np.minimum(at, len(data) - 1)]], 0)
        out = out * np.uint64(257) + byte.astype(np.uint64)
    return mix(out)


def free_name(names: list[str], name: str) -> str:
    """A column name that is not taken, whatever its case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name = f"_{name}"
    return name
