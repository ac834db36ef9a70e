"""Periodic runs of words: suffix trees of a stretch and of its reversal answer how far two places agree.

A run is a longest stretch of words with smallest period q, here of at least `LEAST` words and `TIMES`
periods. Every run has a Lyndon word of length q in it that is the longest one at its place, in the
order of the words or in the reverse order. So there are at most two candidates at each place; each is
extended to the right and left by the longest common extension of two places, which is the depth of
the lowest common ancestor of two leaves: constant time over the Euler tour of a suffix tree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import words as wd

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3


# --- Suffix trees


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers from 1, closed by 0; built in time in proportion to its length.

    Nodes are numbers, node 0 is the root; `at[node]` and `stop[node]` are the ends of the label of the edge
    into it, `child` leads from a node and the first number of an edge to the next node.
    """

    def __init__(self, text: list[int]):
        text = [*text, 0]
        n = len(text)
        self.text, self.base = text, max(text) + 1
        base, child = self.base, {}
        at, stop, link = [0], [0], [0]
        node, edge, length, left = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            left += 1
            last = -1  # the inner node made last, whose link is not known yet
            while left:
                if not length:
                    edge = i
                key = node * base + text[edge]
                down = child.get(key)
                if down is None:
                    child[key] = len(at)
                    at.append(i)
                    stop.append(n)
                    link.append(0)
                    if last >= 0:
                        link[last] = node
                        last = -1
                else:
                    size = min(stop[down], i + 1) - at[down]
                    if length >= size:
                        edge, length, node = edge + size, length - size, down
                        continue
                    if text[at[down] + length] == symbol:
                        if last >= 0:
                            link[last] = node
                        length += 1
                        break
                    middle = len(at)
                    child[key] = middle
                    at.append(at[down])
                    stop.append(at[down] + length)
                    link.append(0)
                    at[down] += length
                    child[middle * base + text[at[down]]] = down
                    child[middle * base + symbol] = middle + 1
                    at.append(i)
                    stop.append(n)
                    link.append(0)
                    if last >= 0:
                        link[last] = middle
                    last = middle
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.at, self.stop, self.child, self.n = at, stop, child, n

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depths along the Euler tour, the tour place of each suffix's leaf, and suffixes in their order.

        Children are visited by the first number of their edge, so leaves come in the order of the suffixes.
        """
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        by = np.argsort(keys)
        parents, nodes = keys[by] // self.base, nodes[by].tolist()
        first = np.searchsorted(parents, np.arange(len(self.at) + 1)).tolist()
        at, stop, n = self.at, self.stop, self.n
        depths, leaf, order = [0], [0] * n, []
        path, following, level = [0], [first[0]], [0]
        while path:
            node, k = path[-1], following[-1]
            if k == first[node + 1]:
                path.pop()
                following.pop()
                level.pop()
                if path:
                    depths.append(level[-1])
                continue
            following[-1] = k + 1
            down = nodes[k]
            deep = level[-1] + stop[down] - at[down]
            if first[down] == first[down + 1]:  # a leaf
                leaf[n - deep] = len(depths)
                order.append(n - deep)
                depths.append(deep)
                depths.append(level[-1])
            else:
                path.append(down)
                following.append(first[down])
                level.append(deep)
                depths.append(deep)
        return np.array(depths, np.int32), np.array(leaf, np.int64), np.array(order, np.int64)


class Extensions:
    """How many numbers two suffixes have in common: the least depth of the tour between their leaves."""

    def __init__(self, text: list[int]):
        depths, self.leaf, self.order = SuffixTree(text).tour()
        self.least = [depths]
        step = 1
        while 2 * step <= len(depths):
            above = self.least[-1]
            self.least.append(np.minimum(above[:-step], above[step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different suffixes; the closing number is shared by none."""
        x, y = self.leaf[a], self.leaf[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][x[at]], self.least[k][y[at] - (1 << k) + 1])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix the next one that is smaller: the longest Lyndon word at a place ends before it."""
    out, waiting = [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        while waiting and rank[waiting[-1]] > rank[i]:
            waiting.pop()
        out[i] = waiting[-1] if waiting else len(rank)
        waiting.append(i)
    return np.array(out, np.int64)


def all_runs(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least two periods in a sequence of numbers from 1."""
    n = len(text)
    if n < 2:
        return []
    ahead, back = Extensions(text), Extensions(text[::-1])
    rank = np.empty(n + 1, np.int64)
    rank[ahead.order] = np.arange(n + 1)
    found = set()
    # The order of numbers in which a run's follower is smaller than the word it differs from finds the run; a
    # run at the end is followed by the closing number, the smallest in the first order.
    for order in (rank[:n], -rank[:n]):
        i = np.arange(n)
        period = _next_smaller(order.tolist()) - i
        two = i + period < n
        i, period = i[two], period[two]
        right = ahead.common(i, i + period)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.common(n - i[inner], n - i[inner] - period[inner])
        start, length = i - left, left + period + right
        full = length >= 2 * period
        found.update(zip(start[full].tolist(), length[full].tolist(), period[full].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


# --- Runs of a text


def _gram(least: int, times: int) -> int:
    """Words for which a run of any period agrees with itself one period on, as a power of two."""
    fewest = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    return 1 << (fewest.bit_length() - 1)


def stretches(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches outside which no word of a run can be, from repeats of grams (16 words at these bounds).

    In a run of period q, places agree with those q words on for at least max(least - q, (times - 1) q)
    words, so from its start on, for all of these places but gram - 1, a gram begins that comes again at most q
    words on. Places whose gram comes again later than a run of so many places allows are left out, until
    none is. What remains is lengthened by a gram and the longest period that its places allow.
    """
    n, gram = len(codes), _gram(least, times)
    if n < least:
        return []
    with np.errstate(over="ignore"):
        mixed, power, size = wd.mix(codes.astype(np.uint64) + np.uint64(1)), np.uint64(0x9E3779B97F4A7C15 | 5), 1
        while size < gram:
            mixed = mixed[:-size] * power + mixed[size:]
            power, size = power * power, 2 * size
    by = np.argsort(mixed, kind="stable")
    same = np.flatnonzero(mixed[by[1:]] == mixed[by[:-1]])
    here, again = by[same], by[same + 1]
    sort = np.argsort(here)
    here, ahead = here[sort], (again - here)[sort]
    while len(here):
        cut = np.flatnonzero(np.diff(here) != 1) + 1
        first, end = np.r_[0, cut], np.r_[cut, len(here)]
        longest = np.minimum(n // times, (end - first + gram - 1) // (times - 1))
        keep = ahead <= np.repeat(longest, end - first)
        if keep.all():
            break
        here, ahead = here[keep], ahead[keep]
    if not len(here):
        return []
    start, stop = here[first], np.maximum.accumulate(np.minimum(here[end - 1] + gram + longest, n))
    new = np.flatnonzero(start[1:] > stop[:-1]) + 1
    return list(zip(start[np.r_[0, new]].tolist(), stop[np.r_[new, len(start)] - 1].tolist(), strict=True))


def runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `times` periods, by start, then period."""
    out = []
    for a, b in stretches(codes, least, times):
        _, own = np.unique(codes[a:b], return_inverse=True)
        found = all_runs((own + 1).tolist())
        out += [(a + s, n, q) for s, n, q in found if n >= max(least, times * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def coded(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, and only for these."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(words: list[bytes]) -> tuple:
    """Runs of a sequence of words as the columns of `SCHEMA`."""
    found = runs(coded(words))
    best = strongest(found)
    kept = words
    if found:
        kept = [words[i] for i in np.flatnonzero(collapsed(found, len(words))).tolist()]
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change of a tenth of the documents: words from a place on repeat with one period."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _reported(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in wd.few(batches):
            rows = []
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                # Bytes are split at the six ASCII blanks only.
                rows.append(report(change(key.as_py(), (text.as_py() or b"").split())))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *names])

    return run


def find_runs(docs: DataFrame, key: str = "doc_id", change=lambda key, words: words) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row of `docs`.

    Words are what stands between ASCII blanks, compared byte for byte; a null or empty text has none, no run
    and the digests of nothing. Each row is handled where it is read, repeated rows each; a row without a
    key keeps a null one. `change` may replace a row's words by others, from its key and words.

    A task holds one text's words and the trees of one stretch of it, about a kilobyte for each word
    of the stretch; stretches are only where repeats lie as close as in a run.
    """
    rows = docs.select(docs[key].cast("long").alias("key"), docs["text"])
    return rows.mapInArrow(_reported(change), f"key long, {SCHEMA}").withColumnRenamed("key", key)


def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return find_runs(docs, change=planted)
