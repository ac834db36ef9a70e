"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import sketch
from siftline.llm import words as wd
from siftline.llm.components import components, merged
from siftline.session import scratch_path

#: Words of an n-gram, and similarity in hundredths from which two texts are linked.
GRAM, LEVEL = 5, 80
#: Prefixes are longer by this part of a set than one common n-gram needs.
MORE = 10
#: Fragments that the global order is cut into.
FRAGMENTS = 8
#: Rounds in which each text is compared with one centre outside its component.
STARS = 3
#: Similarity in hundredths of texts that are near, and classes of a crowd of such that gets a centre.
NEAR, CROWD = 50, 32
#: Prefix n-grams that one range of hashes holds, about.
RANGE_ROWS = 400_000
#: Classes that a task remembers having sent; a copy beyond them is sent again and dropped later.
SEEN = 1_000_000
#: Bits of the map of texts that may have a partner (2 MB at any size of the data).
MAP_BITS = 24

#: Pairs whose sets an Arrow batch holds.
PAIR_ROWS = 200

_MULTIPLIERS = wd.mix(np.arange(1, GRAM + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


# --- Sets ---------------------------------------------------------------------------------


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text; a shorter text is one n-gram."""
    n = len(hashes)
    if not n:
        return hashes
    wide = min(n, GRAM)
    out = np.full(n - wide + 1, wide, np.uint64)
    for j in range(wide):
        out += hashes[j : n - wide + 1 + j] * _MULTIPLIERS[j]
    return np.unique(wd.mix(out))


def set_key(grams: np.ndarray) -> int:
    """A signed long that stands for a set: texts with one set are one class."""
    total = wd.mix(grams * np.uint64(0x9E6C63D0876A9A47) + np.uint64(len(grams))).sum(dtype=np.uint64)
    return int(wd.mix(np.array([total]))[0].astype(np.int64))


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, hashes in wd.doc_hashes(column):
        yield row, shingles(hashes)


def _table(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KEYS = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())]
)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key of every set, and at the end of a task the counts of its n-grams."""
    total, held, waiting = np.zeros(1 << sketch.BITS, np.int32), [], 0
    for batch in wd.few(batches):
        ids, digests, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
        for row, grams in _sets(batch.column(1)):
            rows.append((ids[row], digests[row], len(grams), set_key(grams) if len(grams) else None, None, None))
            held.append(grams)
            waiting += len(grams)
            if waiting > 1 << 20:
                sketch.add(total, np.concatenate(held))
                held, waiting = [], 0
        if rows:
            yield _table(list(zip(*rows, strict=True)), _KEYS)
    if held:
        sketch.add(total, np.concatenate(held))
    rows = [(None, None, None, None, *s) for s in sketch.slices(total)]
    if rows:
        yield _table(list(zip(*rows, strict=True)), _KEYS)


# --- The global order -----------------------------------------------------------------------


class Order:
    """A total order of n-grams: rare ones first, as the counts have them, then by hash.

    Any fixed order gives the same links; the counts only keep common n-grams out of prefixes. The
    first 8 bits of an order key are the logarithm of the count, the others are of the hash.
    """

    def __init__(self, counts: np.ndarray):
        self.level = np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)
        # Cut points between fragments that hold about equally many n-grams.
        mass = np.bincount(self.level, counts.astype(np.float64), 256)
        upto = np.cumsum(mass)
        cuts = []
        for share in np.arange(1, FRAGMENTS) / FRAGMENTS * upto[-1]:
            at = int(np.searchsorted(upto, share))
            inside = (share - (upto[at] - mass[at])) / mass[at] if mass[at] else 0.0
            cuts.append((at << 56) + min(int(inside * 2.0**56), (1 << 56) - 1))
        self.cuts = np.array(cuts, np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Sorted order keys of a set. Equal keys are equal n-grams but for chance of 1 in 2 ** 56."""
        level = self.level[(grams >> np.uint64(64 - sketch.BITS)).astype(np.int64)].astype(np.uint64)
        return np.sort((level << np.uint64(56)) | (wd.mix(grams) >> np.uint64(8)))

    def fragments(self, keys: np.ndarray) -> list[np.ndarray]:
        return np.split(keys, np.searchsorted(keys, self.cuts))


def needed(a: np.ndarray | Column, b: np.ndarray | Column, level: int = LEVEL):
    """Least overlap, times (100 + level), of sets with `a` and `b` n-grams that are so similar."""
    return (a + b) * level


def prefix(n: int) -> int:
    """N-grams at the front that a set is known by.

    A linked set shares LEVEL / 100 of it at least, so some of the first n - LEVEL n / 100 + 1. With
    n / MORE further ones, linked sets of `a` and `b` n-grams share more than min(a, b) / MORE of those.
    """
    return n - -(-n * LEVEL // 100) + 1 + n // MORE


def _enough(shared: Column, a: Column, b: Column) -> Column:
    return shared > F.floor(F.least(a, b) / MORE)


# --- Candidates -----------------------------------------------------------------------------


_PREFIX = pa.schema([("range", pa.int32()), ("key", pa.binary()), ("low", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])


def _prefixes(order, ranges: int):
    """Prefix n-grams of the texts of a task, one row for each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in wd.few(batches):
            if len(seen) > SEEN:
                seen.clear()
            keys, lows, sizes, places = [], [], [], []
            for _, grams in _sets(batch.column(0)):
                low = set_key(grams) if len(grams) else 0
                if not len(grams) or low in seen:
                    continue
                seen.add(low)
                first = order.value.keys(grams)[: prefix(len(grams))]
                keys.append(first)
                lows.append(np.full(len(first), low, np.int64))
                sizes.append(np.full(len(first), len(grams), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if not keys:
                continue
            key, low, n, pos = map(np.concatenate, (keys, lows, sizes, places))
            part = (wd.mix(key) % np.uint64(ranges)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            found, cuts = np.unique(part[by], return_index=True)
            columns = [np.split(x[by], cuts[1:]) for x in (key, low, n, pos)]
            rows = [found.tolist(), *[[x.tobytes() for x in c] for c in columns]]
            yield _table(rows, _PREFIX)

    return run


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix n-grams that at least two different sets have, of the ranges in a partition."""
    held: dict[int, list[tuple]] = {}
    for frame in frames:
        for at, *raw in frame.itertuples(index=False):
            kinds = (np.uint64, np.int64, np.int32, np.int32)
            held.setdefault(at, []).append(tuple(np.frombuffer(x, k) for x, k in zip(raw, kinds, strict=True)))
    for at in list(held):
        key, low, n, pos = (np.concatenate(x) for x in zip(*held.pop(at), strict=True))
        by = np.lexsort((low, key))
        key, low, n, pos = key[by], low[by], n[by], pos[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])  # the same set from several tasks
        key, low, n, pos = key[new], low[new], n[new], pos[new]
        same = key[1:] == key[:-1]
        many = np.r_[same, False] | np.r_[False, same]
        yield pd.DataFrame({"gram": key[many].astype(np.int64), "low": low[many], "n": n[many], "pos": pos[many]})


def _may_link(na: Column, nb: Column, shared: Column, pa_: Column, pb: Column) -> Column:
    """Whether sets can reach the level that share `shared` n-grams up to places `pa_` and `pb`.

    The last shared prefix n-gram is at those places, so no other n-gram before them is shared:
    the overlap is at most what is shared already and the shorter rest.
    """
    most = shared + F.least(na - pa_ - 1, nb - pb - 1)
    return most * (100 + LEVEL) >= needed(na, nb)


def _fits(na: Column, nb: Column) -> Column:
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * LEVEL)


def _pairs(both: DataFrame, whole: bool = True) -> DataFrame:
    """Pairs (a, b, na, nb, shared) out of rows that each tell some n-grams they share.

    `whole` says that the rows are of whole prefixes; else the common n-grams beyond some place of the
    left set are missing, and all before it are there.
    """
    told = both.groupBy("a", "b").agg(
        F.first("na").alias("na"),
        F.first("nb").alias("nb"),
        F.sum("shared").alias("shared"),
        F.max("pa").alias("pa"),
        F.max("pb").alias("pb"),
    )
    told = told.filter(_may_link(*[F.col(c) for c in ("na", "nb", "shared", "pa", "pb")]))
    if whole:
        told = told.filter(_enough(F.col("shared"), F.col("na"), F.col("nb")))
    return told.select("a", "b", "na", "nb", "shared")


def _enough_for_any(shared: Column, n: Column) -> Column:
    return _enough(shared, n, -F.floor(-n * LEVEL / 100))  # the smallest linked set


def _promising(shared: DataFrame) -> DataFrame:
    """Rows of classes that share enough of their prefix with others for any of these to be linked."""
    some = shared.groupBy("low").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.join(some.filter(_enough_for_any(F.col("shared"), F.col("n"))).select("low"), "low", "left_semi")


def _open(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with their component, of n-grams whose texts are not all in one."""
    parts = parts.select(F.col("node").alias("low"), "component")
    s = shared.join(parts, "low", "left").withColumn("component", F.coalesce("component", "low"))
    several = s.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return s.join(several.select("gram"), "gram", "left_semi")


def _star_pairs(shared: DataFrame, parts: DataFrame, salt: int) -> DataFrame:
    """Each text with one centre of the groups that it shares an n-gram with.

    The centre of an n-gram's texts of like size is the one with the smallest salted hash, so texts that share
    many n-grams mostly agree on it; of its centres a text takes that with the most shared n-grams.
    """
    rank = F.xxhash64("low", F.lit(salt))
    names = ("low", "n", "pos", "component")
    # Sets of like size, with borders that move by the round: others could not be linked anyway.
    size = F.floor(F.log(F.col("n").cast("double")) * 10 + F.lit(salt / STARS)).alias("size")
    s = _open(shared, parts).select("*", size)
    centre = s.groupBy("gram", "size").agg(F.min_by(F.struct(*names), F.struct(rank, "low")).alias("c"))
    both = s.join(centre, ["gram", "size"]).filter(F.col("component") != F.col("c.component"))
    both = both.select(
        F.col("low").alias("a"), F.col("c.low").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"),
        F.col("pos").alias("pa"), F.col("c.pos").alias("pb"), F.lit(1).alias("shared"),
    ).filter(_fits(F.col("na"), F.col("nb")))
    told = _pairs(both)
    best = told.groupBy("a").agg(F.max_by(F.struct("b", "na", "nb"), F.struct("shared", "b")).alias("x"))
    best = best.select("a", "x.b", "x.na", "x.nb")
    turned = F.col("a") > F.col("b")
    return best.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()


#: Meetings of two texts that a task looks at together.
MEETINGS = 1 << 19

_PARTIAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), *[(c, pa.int32()) for c in ("na", "nb", "pa", "pb")], ("shared", pa.int64())])


def _rows(rows: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, j], f.type) for j, f in enumerate(schema)], schema=schema)


def _new(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.r_[True, x[1:] != x[:-1]]


def _summed(held: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, na, nb, pa, pb, shared) with one for each pair: the last places, and the n-grams counted."""
    rows = np.concatenate(held)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    at = np.flatnonzero(_new(rows[:, 0]) | _new(rows[:, 1]))
    out = rows[at]
    for j, add in ((4, np.maximum), (5, np.maximum), (6, np.add)):
        out[:, j] = add.reduceat(rows[:, j], at)
    return out


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of rows that come by n-gram, which is the first; no n-gram goes on in the next block."""
    rest = None
    for batch in batches:
        rows = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns], axis=1)
        rows = rows if rest is None else np.concatenate([rest, rows])
        if not len(rows):
            continue
        last = np.flatnonzero(rows[:, 0] != rows[-1, 0])
        whole = int(last[-1]) + 1 if len(last) else 0
        rest = rows[whole:]
        if whole:
            yield rows[:whole].T
    if rest is not None and len(rest):
        yield rest.T


def _few(count: np.ndarray) -> Iterator[slice]:
    """Slices of rows that have `MEETINGS` meetings together, or are one row."""
    upto, at = np.cumsum(count), 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, side="right")))
        yield slice(at, end)
        at = end


def _met(some: slice, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (left, right) of meetings: each row with `count` others from `start` on; and the number of each."""
    n = count[some]
    left = np.repeat(np.arange(some.start, some.stop), n)
    number = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
    return left, start[left] + number, number


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of the fragments in a partition; rows come by fragment, then n-gram, then crowd.

    The smaller set seeks the larger one. Texts of one crowd have met already and are not listed again.
    """
    held: list[np.ndarray] = []
    for gram, low, n, pos, component, seeks, crowd in _by_gram(batches):
        first = np.flatnonzero(_new(gram))
        size = np.diff(np.r_[first, len(gram)])
        start, size = np.repeat(first, size), np.repeat(size, size)
        begin = np.flatnonzero(_new(gram) | _new(crowd))
        own = np.diff(np.r_[begin, len(gram)])
        begin, own = np.repeat(begin, own), np.repeat(own, own)
        count = (size - own) * seeks
        for some in _few(count):
            left, right, _ = _met(some, start, count)
            right += np.where(right >= begin[left], own[left], 0)
            na, nb = n[left], n[right]
            good = (component[left] != component[right]) & (na * 100 >= nb * LEVEL)
            good &= (na < nb) | ((na == nb) & (low[left] < low[right]))
            left, right = left[good], right[good]
            one = np.ones(len(left), np.int64)
            held.append(np.stack([low[left], low[right], n[left], n[right], pos[left], pos[right], one], axis=1))
            if sum(map(len, held)) > MEETINGS:
                held = [_summed(held)]
                if len(held[0]) > MEETINGS // 4:
                    yield _rows(held.pop(), _PARTIAL)
    if held:
        yield _rows(_summed(held), _PARTIAL)


def _cross_pairs(shared: DataFrame, parts: DataFrame, crowds: DataFrame | None) -> DataFrame:
    """All pairs that share a prefix n-gram, are not yet in one component or of one crowd, and may link."""
    s = _open(shared, parts)
    crowd = F.col("component")  # no more than a run of rows to leave out
    if crowds is not None:
        s = s.join(crowds.select("low", "hub"), "low", "left")
        crowd = F.when(F.col("hub").isNull(), crowd).otherwise(F.xxhash64("hub", F.lit("crowd")))
    # A set overlaps a linked one that is no smaller in 2 LEVEL / (100 + LEVEL) of itself at least, and
    # one that is smaller in LEVEL / 100, so the smaller (left) is sought by fewer n-grams.
    few = F.col("n") + 1 + F.floor(-F.col("n") * (2 * LEVEL) / (100 + LEVEL))
    most = F.col("n") + 1 + F.floor(-F.col("n") * LEVEL / 100)
    # The order is cut into fragments of about RANGE_ROWS n-grams; overlaps are counted in each, summed by pair.
    s = s.filter(F.col("pos") < most)
    fragments = max(FRAGMENTS, -(-s.count() // RANGE_ROWS))
    cuts = s.agg(F.percentile_approx("gram", [k / fragments for k in range(1, fragments)], 10_000)).first()[0] or []
    fragment = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("gram")))
    seeks = (F.col("pos") < few).cast("int").alias("seeks")
    dealt = s.select("gram", "low", "n", "pos", "component", seeks, crowd.alias("crowd"), fragment.alias("fragment"))
    dealt = dealt.repartition(fragments, "fragment").sortWithinPartitions("gram", "crowd").drop("fragment")
    both = dealt.mapInArrow(_partial, "a long, b long, na int, nb int, pa int, pb int, shared long")
    told = _pairs(both, whole=False)
    turned = F.col("a") > F.col("b")
    return told.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"),
        "shared",
    )


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose texts are not in one component."""
    for side in ("a", "b"):
        mine = parts.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(mine, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.filter("of_a <> of_b").drop("of_a", "of_b")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each text's pairs the one with the most n-grams known to be shared."""
    pair = F.struct("a", "b", "na", "nb")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x"), pair.alias("pair"), "shared")
    best = ends.groupBy("x").agg(F.max_by("pair", F.struct("shared", "pair")).alias("pair"))
    return best.select("pair.*").distinct()


# --- Overlaps by fragment ---------------------------------------------------------------------


_PAGE = 1 << 12
_PAGES = pa.schema([("page", pa.int32()), ("bits", pa.binary())])
_SEGMENT = pa.schema([("low", pa.int64()), ("fragment", pa.int32()), ("grams", pa.binary())])


def _segments(order, marks):
    """Sets of texts that may have a partner, cut into fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in wd.few(batches):
            rows: list[tuple] = []
            for _, grams in _sets(batch.column(0)):
                low = set_key(grams) if len(grams) else 0
                if not len(grams) or low in seen or not _marked(marks.value, low):
                    continue
                seen.add(low)
                parts = order.value.fragments(order.value.keys(grams))
                rows += [(low, i, x.tobytes()) for i, x in enumerate(parts) if len(x)]
            if rows:
                yield _table(list(zip(*rows, strict=True)), _SEGMENT)

    return run


def _marked(marks: np.ndarray, low: int) -> bool:
    at = (low >> (64 - MAP_BITS)) & ((1 << MAP_BITS) - 1)
    return bool(marks[at >> 3] >> (at & 7) & 1)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit map of the texts of a task."""
    bits = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        low = batch.column(0).to_numpy().view(np.uint64)
        bits[(low >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    raw = np.packbits(bits, bitorder="little")
    rows = [(i, raw[i * _PAGE : (i + 1) * _PAGE].tobytes()) for i in range(len(raw) // _PAGE)]
    rows = [r for r in rows if any(r[1])]
    if rows:
        yield _table(list(zip(*rows, strict=True)), _PAGES)


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All bits of each page; a partition holds few pages, however many rows they have."""
    pages: dict[int, np.ndarray] = {}
    for frame in frames:
        for at, raw in zip(frame["page"], frame["bits"], strict=True):
            mine = pages.setdefault(at, np.zeros(_PAGE, np.uint8))
            mine |= np.frombuffer(raw, np.uint8)
    yield pd.DataFrame({"page": list(pages), "bits": [p.tobytes() for p in pages.values()]}).astype({"page": "int32"})


def _marks(shared: DataFrame) -> np.ndarray:
    """A bit for each text that shares a prefix n-gram; other texts may have one by chance."""
    rows = shared.select("low").mapInArrow(_mark, "page int, bits binary")
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for row in rows.repartition("page").mapInPandas(_merge, "page int, bits binary").collect():
        out[row.page * _PAGE : (row.page + 1) * _PAGE] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _overlap(x: list[dict], y: list[dict], most: int) -> int:
    """Overlap of two sets, counted by fragment and summed; it ends where the rest cannot reach `most`."""
    other = {s["fragment"]: np.frombuffer(s["grams"], np.uint64) for s in y}
    total, rest = 0, sum(len(g) for g in other.values())
    for s in x:
        theirs = other.get(s["fragment"])
        if theirs is None:
            continue
        total += len(np.intersect1d(np.frombuffer(s["grams"], np.uint64), theirs, assume_unique=True))
        rest -= len(theirs)
        if total + rest < most:
            break
    return total


def _compared(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, linked) out of (a, b, na, nb, x, y) whose similarity reaches `level`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (c.to_pylist() for c in batch.columns[:4])
            kept, linked = [], []
            for i in range(batch.num_rows):
                most = -(-needed(na[i], nb[i], level) // (100 + level))
                both = _overlap(batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), most)
                if both >= most:
                    kept.append(i)
                    linked.append(both * (100 + LEVEL) >= needed(na[i], nb[i]))
            columns = [pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked"])

    return run


def _told(pairs: DataFrame, segments: DataFrame, level: int) -> DataFrame:
    """Pairs (a, b, linked) whose overlaps, counted by fragment and summed, reach `level`."""
    cut = F.sort_array(F.collect_list(F.struct("fragment", "grams")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("low")).distinct()
    sets = segments.join(ends, "low", "left_semi").groupBy("low").agg(cut.alias("cut"))
    each = pairs.join(sets.select(F.col("low").alias("a"), F.col("cut").alias("x")), "a")
    each = each.join(sets.select(F.col("low").alias("b"), F.col("cut").alias("y")), "b")
    return each.select("a", "b", "na", "nb", "x", "y").mapInArrow(_compared(level), "a long, b long, linked boolean")


# --- Crowds -----------------------------------------------------------------------------------
#
# Near copies of one text share most n-grams, so most pairs of them share some of a prefix. They are told
# apart by how they differ from their centre, the n-grams that more than half of them have. With D the
# n-grams that a set has and the centre has not, or the reverse, sets differ in |D_a| + |D_b| - 2 |D_a & D_b|
# n-grams, and link if that is at most (100 - LEVEL) / (100 + LEVEL) of both sizes. In terms of
#     cost = (100 + LEVEL) |D| - (100 - LEVEL) n
# they link if cost_a + cost_b <= 2 (100 + LEVEL) |D_a & D_b|.

_DIFFERENT = pa.schema([("hub", pa.int64()), ("low", pa.int64()), ("fragment", pa.int32()), ("n", pa.int32()), ("grams", pa.binary())])
_GRAMS = pa.schema([("hub", pa.int64()), ("low", pa.int64()), ("fragment", pa.int32()), ("gram", pa.int64())])
_MEET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32())])


def _grams(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", np.uint64)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences of sets and centres, by fragment, out of (hub, low, fragment, mine, theirs, turned)."""
    for batch in batches:
        rows = []
        for hub, low, fragment, mine, theirs, turned in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            mine = _grams(mine)
            both = np.setxor1d(mine, _grams(theirs), assume_unique=True)
            both = np.setxor1d(both, np.array(turned or [], np.int64).view(np.uint64), assume_unique=True)
            rows.append((hub, low, fragment, len(mine), both.tobytes()))
        if rows:
            yield _table(list(zip(*rows, strict=True)), _DIFFERENT)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each n-gram of differences (hub, low, fragment, grams)."""
    for batch in batches:
        grams = [_grams(x) for x in batch.column(3).to_pylist()]
        if grams:
            names = [np.repeat(c.to_numpy(zero_copy_only=False), [len(g) for g in grams]) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, np.concatenate(grams).view(np.int64))], schema=_GRAMS)


def _differences(crowds: DataFrame, segments: DataFrame, turned: DataFrame | None) -> DataFrame:
    """(hub, low, fragment, n, grams): how the classes of `crowds` differ from the set of their hub,
    in which the n-grams `turned` (hub, fragment, turned) go or come."""
    rows = crowds.select("hub", "low", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    mine = segments.join(crowds.select("low"), "low", "left_semi").withColumnRenamed("grams", "mine")
    theirs = segments.join(crowds.select(F.col("hub").alias("low")).distinct(), "low", "left_semi")
    theirs = theirs.select(F.col("low").alias("hub"), "fragment", F.col("grams").alias("theirs"))
    rows = rows.join(mine, ["low", "fragment"], "left").join(theirs, ["hub", "fragment"], "left")
    if turned is None:
        rows = rows.withColumn("turned", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(turned, ["hub", "fragment"], "left")
    rows = rows.select("hub", "low", "fragment", "mine", "theirs", "turned")
    return rows.mapInArrow(_differ, "hub long, low long, fragment int, n int, grams binary")


def _crowded(near: DataFrame) -> DataFrame:
    """(hub, low): the classes that near ones reach, where they are `CROWD` at least; the hub is one of them."""
    parts = components(near, "a", "b").select(F.col("component").alias("hub"), F.col("node").alias("low"))
    return parts.join(parts.groupBy("hub").count().filter(F.col("count") >= CROWD).select("hub"), "hub", "left_semi")


def _beside(crowds: DataFrame, shared: DataFrame) -> DataFrame:
    """(hub, low): classes of no crowd, with the crowd whose members have most of their prefix; others have no link there."""
    held = shared.join(crowds, "low").select("gram", "hub").distinct()
    some = shared.join(crowds, "low", "left_anti").join(held, "gram")
    some = some.groupBy("low", "hub").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    some = some.filter(_enough_for_any(F.col("shared"), F.col("n")))
    return some.groupBy("low").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub")).select("hub", "low")


def _centred(crowds: DataFrame, beside: DataFrame, segments: DataFrame) -> DataFrame:
    """Differences from the centres: of the hub's set, n-grams that most members lack go and those they have come."""
    first = _stored(_differences(crowds, segments, None), "differences")
    counts = first.select("hub", "low", "fragment", "grams").mapInArrow(_listed, "hub long, low long, fragment int, gram long")
    counts = counts.groupBy("hub", "fragment", "gram").agg(F.count("*").alias("n"))
    most = counts.join(crowds.groupBy("hub").agg(F.count("*").alias("members")), "hub").filter("2 * n > members")
    turned = most.groupBy("hub", "fragment").agg(F.collect_list("gram").alias("turned"))
    return _stored(_differences(crowds.unionByName(beside), segments, turned), "centred")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link, out of (gram, low, n, component, cost, room, seeks); rows come by n-gram, then cost.

    `room` is how many n-grams of the difference come from this one on. The first that a pair has in common
    leaves both as much room as the overlap they need.
    """
    held: list[np.ndarray] = []
    unit = 2 * (100 + LEVEL)
    for gram, low, n, component, cost, room, seeks in _by_gram(batches):
        new = _new(gram)
        number = np.cumsum(new) - 1
        start = np.flatnonzero(new)[number]
        # The rows of the n-gram whose cost leaves enough room here are the first ones.
        shift = int(cost.min())
        wide = int(cost.max()) - shift + 1
        limit = np.clip(room * unit - cost - shift, -1, wide - 1)
        upto = np.searchsorted(number * wide + (cost - shift), number * wide + limit, side="right")
        count = np.maximum(upto - start, 0) * seeks
        for some in _few(count):
            left, right, _ = _met(some, start, count)
            need = np.maximum(1, -(-(cost[left] + cost[right]) // unit))
            good = (component[left] != component[right]) & (need <= room[left]) & (need <= room[right])
            left, right = left[good], right[good]
            turned = low[left] > low[right]
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            held.append(np.stack([low[left], low[right], n[left], n[right]], axis=1))
            if sum(map(len, held)) > MEETINGS:
                held = [np.unique(np.concatenate(held), axis=0)]
                if len(held[0]) > MEETINGS // 4:
                    yield _rows(held.pop(), _MEET)
    if held:
        yield _rows(np.unique(np.concatenate(held), axis=0), _MEET)


def _costs(centred: DataFrame) -> DataFrame:
    """(hub, low, n, size, cost, least, best): classes near their centre, with the least cost of its crowd."""
    of = centred.groupBy("hub", "low").agg(F.sum("n").alias("n"), F.sum(F.length("grams") / 8).cast("long").alias("size"))
    of = of.filter(F.col("size") * 2 <= F.col("n")).withColumn("cost", F.col("size") * (100 + LEVEL) - F.col("n") * (100 - LEVEL))
    least = of.groupBy("hub").agg(F.min("cost").alias("least"), F.min_by("low", F.struct("cost", "low")).alias("best"))
    return of.join(least, "hub")


def _central_links(costs: DataFrame) -> DataFrame:
    """Links of the classes that need no common difference with the one nearest to the centre.

    Any two that need none are linked by these, as the nearest one needs less than either.
    """
    return costs.filter((F.col("cost") + F.col("least") <= 0) & (F.col("low") != F.col("best"))).select(F.col("low").alias("a"), F.col("best").alias("b"))


def _crowd_pairs(centred: DataFrame, costs: DataFrame, parts: DataFrame) -> DataFrame:
    """All pairs of a crowd that are not yet in one component and may link: they have some rare difference in common.

    Those in the component of the class nearest to the centre are sought by the others.
    """
    parts = parts.select(F.col("node").alias("low"), "component")
    of = costs.join(parts, "low", "left").withColumn("component", F.coalesce("component", "low"))
    main = parts.select(F.col("low").alias("best"), F.col("component").alias("main"))
    of = of.join(main, "best", "left")
    of = of.withColumn("seeks", (F.col("component") != F.coalesce("main", "best")).cast("int"))
    grams = centred.select("hub", "low", "fragment", "grams").mapInArrow(_listed, "hub long, low long, fragment int, gram long")
    grams = grams.join(of.select("low"), "low", "left_semi")
    often = grams.groupBy("hub", "gram").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("low").orderBy("often", "gram"))
    rows = grams.join(often, ["hub", "gram"]).withColumn("place", place).filter("often > 1").join(of.drop("hub"), "low")
    rows = rows.withColumn("room", F.col("size") - F.col("place") + 1)
    rows = rows.filter(F.col("room") * (2 * (100 + LEVEL)) >= F.col("cost") + F.col("least"))
    rows = rows.select(F.xxhash64("hub", "gram").alias("gram"), "low", "n", "component", "cost", "room", "seeks")
    rows = rows.repartition("gram").sortWithinPartitions("gram", "cost")
    return rows.mapInArrow(_meet, "a long, b long, na int, nb int").distinct()


# --- The operator -----------------------------------------------------------------------------


def _stored(df: DataFrame, name: str, rows: int = wd.FEW) -> DataFrame:
    """`df` as a written table; Python workers get `rows` rows at a time."""
    at = scratch_path(df.sparkSession, name)
    with wd.batch_rows(df.sparkSession, rows):
        df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, digest, n, low, component_id): one row per row of `docs`, with a hash of its text.

    Rows without a set have no `low`.
    """
    spark = docs.sparkSession
    df = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("digest"))
    told = _stored(df.mapInArrow(_describe, "doc_id long, digest long, n long, low long, slice int, counts binary"), "sets")
    keys = told.filter("slice is null").select("doc_id", "digest", "n", "low")
    order = spark.sparkContext.broadcast(Order(sketch.collect(told.filter("slice is not null").select("slice", "counts"))))
    total = keys.agg(F.sum(F.col("n") * ((100 - LEVEL) / 100 + 1 / MORE) + 1)).first()[0] or 0
    ranges = max(64, -(-int(total) // RANGE_ROWS))
    texts = df.select("text")
    sent = texts.mapInArrow(_prefixes(order, ranges), "range int, key binary, low binary, n binary, pos binary")
    told = _stored(sent.repartition("range").mapInPandas(_shared, "gram long, low long, n int, pos int"), "prefixes")
    shared = _stored(_promising(told), "promising")
    marks = spark.sparkContext.broadcast(_marks(shared))
    parts = texts.mapInArrow(_segments(order, marks), "low long, fragment int, grams binary")
    segments = _stored(parts, "segments").groupBy("low", "fragment").agg(F.first("grams").alias("grams"))
    parts = spark.createDataFrame([], "node long, component long")
    tried: list[DataFrame] = []

    def compared(found: DataFrame, level: int = LEVEL) -> DataFrame | None:
        """The pairs that were not compared before, as far as they reach `level`."""
        if tried:
            found = found.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        pairs = _stored(found, "pairs")
        if pairs.isEmpty():
            return None
        tried.append(pairs.select("a", "b"))
        return _stored(_told(pairs, segments, level), "links", PAIR_ROWS)

    def joined(parts: DataFrame, told: DataFrame | None) -> DataFrame:
        return parts if told is None else merged(parts, told.filter("linked"), "a", "b")

    near: list[DataFrame] = []
    for turn in range(STARS):
        told = compared(_star_pairs(shared, parts, turn), NEAR)
        if told is not None:
            near.append(told.select("a", "b"))
            parts = joined(parts, told)
    costs = None
    if near:
        crowds = _stored(_crowded(reduce(DataFrame.unionByName, near)), "crowds")
        if not crowds.isEmpty():
            centred = _centred(crowds, _stored(_beside(crowds, shared), "beside"), segments)
            costs = _stored(_costs(centred), "costs")
            parts = merged(parts, _stored(_central_links(costs), "links"), "a", "b")
            parts = joined(parts, compared(_crowd_pairs(centred, costs, parts)))
    rest = _stored(_cross_pairs(shared, parts, costs), "rest")
    parts = joined(parts, compared(_best(rest)))
    parts = joined(parts, compared(_apart(rest, parts).drop("shared")))
    linked = parts.withColumnRenamed("node", "low")
    classes = keys.filter("low is not null").groupBy("low").agg(F.min("doc_id").alias("least"))
    classes = classes.join(linked, "low", "left").withColumn("component", F.coalesce("component", "low"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "component").select("low", "component", "component_id")
    out = keys.join(classes, "low", "left")
    return out.select("doc_id", "digest", "n", F.col("component").alias("low"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of `docs`.

    Words are cut at white space, A-Z in lower case; a text's set is its distinct shingles of `GRAM`
    words. Texts link when their sets' Jaccard similarity is `LEVEL` / 100 or more; a
    component's id is the smallest key that links reach. Null and empty texts have no set and no
    link. Repeated rows and equal texts are one class and linked; other columns are ignored.

    1. One pass describes every text and counts n-grams in a sketch of fixed size, which sets the
       global order. Texts with one set become a class, and only classes go on.
    2. A class sends the rare end of its set, of which any linked set must share a known part. Classes
       that share less with all others together have no link.
    3. In each of `STARS` rounds every class is compared with one centre outside its component, and
       what links falls into components, to which later links are contracted.
    4. Near classes in crowds are known by how they differ from their crowd's centre. Most link through the
       class nearest to it; of the others only those are compared that differ alike in some rare way.
    5. Of the other pairs that are not yet in one component but may link, every class's best is compared, then
       all that are left. These pairs come from partial overlaps in fragments of the order, summed by pair.
    6. Pairs are counted by fragment of the order and summed.

    No common n-gram is left out: it comes last in the order, where it joins texts that have
    little else. A pair is dropped only where its overlap cannot reach the level.
    """
    return _grouped(docs, key, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without near copies: of each component one row stays, that with the smallest key.

    A row is known by its key and a hash of its text, so of rows with one key those that are no copies stay. If
    several texts of a component have the smallest key, the one with the smallest hash stays; of rows that
    repeat key and text one stays. Rows with a null key stay, and rows without a set are copies of nothing.
    Only narrow rows are joined to the texts, and no column is added to them.
    """
    row = ["doc_id", "digest"]
    found = _stored(_grouped(docs, key, text).select(*row, "low").filter("doc_id is not null"), "near")
    first = found.filter("low is not null").groupBy("low").agg(F.min(F.struct(*row)).alias("first"))
    copies = found.join(first, "low").filter(F.struct(*row) != F.col("first")).select(*row).distinct()
    again = found.groupBy(*row).count().filter("count > 1").select(*row).join(copies, row, "left_anti")

    def its(of: DataFrame) -> Column:
        return (docs[key].cast("long") == of["doc_id"]) & (F.xxhash64(docs[text]) == of["digest"])

    gone = copies.unionByName(again)
    return docs.join(gone, its(gone), "left_anti").unionByName(docs.join(again, its(again), "left_semi").dropDuplicates([key, text]))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH w AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (
    SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid
    JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
    WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
    GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT rid, rid FROM w),
r AS (
    WITH RECURSIVE c(rid, to_rid) AS (SELECT a, b FROM e UNION SELECT c.rid, e.b FROM c JOIN e ON c.to_rid = e.a)
    SELECT c.rid, min(d.doc_id) AS component_id FROM c JOIN w d ON d.rid = c.to_rid GROUP BY c.rid)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (rid) JOIN r USING (rid)
"""
