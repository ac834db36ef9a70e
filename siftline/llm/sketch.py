"""Rough counts of hashed values in an array of fixed size, summed over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Counters, and how many travel in one row.
BITS = 22
SLICE = 1 << 14
SCHEMA = "slice int, counts binary"


def slices(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Non-empty rows of a task's counts, each at most 255: one byte is enough to tell common from rare."""
    for i in range(0, len(total), SLICE):
        part = total[i : i + SLICE]
        if part.any():
            yield i // SLICE, np.minimum(part, 255).astype(np.uint8).tobytes()


def add(total: np.ndarray, hashes: np.ndarray) -> None:
    """Count hashes (uint64) by their top bits."""
    at, n = np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    total[at] += n.astype(total.dtype)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by slice; a partition holds few slices, however many rows they have."""
    totals: dict[int, np.ndarray] = {}
    for frame in frames:
        for at, raw in zip(frame["slice"], frame["counts"], strict=True):
            mine = totals.setdefault(at, np.zeros(SLICE, "<i8"))
            mine += np.frombuffer(raw, np.uint8)
    yield pd.DataFrame({"slice": list(totals), "counts": [t.tobytes() for t in totals.values()]}).astype({"slice": "int32"})


def collect(rows: DataFrame) -> np.ndarray:
    """The summed array: 8 bytes a counter at any size of the data."""
    total = np.zeros(1 << BITS, np.int64)
    for row in rows.repartition("slice").mapInPandas(_sums, SCHEMA).collect():
        total[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(bytes(row.counts), "<i8")
    return total
