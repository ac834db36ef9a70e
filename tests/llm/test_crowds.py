"""What the findings on op10 and the pipeline were about: pairs inside large groups of near copies."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from siftline.llm import jaccard  # noqa: E402


def copies(rng, n, words, changes):
    """Texts with some words of one replaced: by new words, or by one of two."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.choice(changes)):
            text[at] = rng.choice(["left", "right", f"z{rng.randrange(10**6)}", f"z{rng.randrange(10**6)}"])
        yield text


def found(spark, rows):
    return sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_near_copies_are_not_expanded_into_pairs(spark, monkeypatch):
    stored, listed = jaccard._stored, []

    def counted(df, name, *rows):
        out = stored(df, name, *rows)
        if name in ("rest", "pairs"):
            listed.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_stored", counted)
    rng = random.Random(5)
    rows = [(i, " ".join(t)) for i, t in enumerate(copies(rng, 500, 100, [2, 3, 3, 4, 4, 5]))]
    got = found(spark, rows)
    assert got == sorted(plain.near(rows))
    assert len({r[2] for r in got}) > 50  # so many that a link of all would not do
    assert sum(listed) < 5 * len(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_crowds_of_many_shapes(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "CROWD", 4)
    rng = random.Random(seed)
    texts = [t for changes in ([0, 1, 9], [3], [2, 2, 3, 12]) for t in copies(rng, 40, rng.randrange(60, 140), changes)]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(90)]  # its ends have nothing in common
    for i in range(90):
        chain[i] = f"d{i}"
        texts.append(list(chain))
    texts += [t[: rng.randrange(len(t) // 2, len(t))] for t in texts[::5]] + [t + ["more"] * rng.randrange(9) for t in texts[::7]]
    ids = rng.sample(range(10**6), len(texts))
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)] + [(7, None), (8, "")]
    assert found(spark, rows) == sorted(plain.near(rows))


@pytest.mark.parametrize("meetings", [1, 7, jaccard.MEETINGS])
def test_partial_overlaps_leave_out_the_own_crowd(monkeypatch, meetings):
    monkeypatch.setattr(jaccard, "MEETINGS", meetings)
    rng = np.random.default_rng(6)
    rows = [
        (gram, low, 10, int(rng.integers(9)), low % 3 if low < 9 else low, int(rng.random() < 0.7), low % 2 if low < 12 else low)
        for gram in range(12) for low in sorted(rng.choice(20, 9, replace=False).tolist(), key=lambda x: x % 2 if x < 12 else x)
    ]
    want = {}
    for g, a, na, place, component, seeks, crowd in rows:
        for h, b, nb, other, others, _, theirs in rows:
            if g == h and seeks and a < b and component != others and crowd != theirs:
                old = want.get((a, b), (0, 0, 0))
                want[a, b] = (max(old[0], place), max(old[1], other), old[2] + 1)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 13], strict=True)], names=list("abcdefg")) for i in range(0, len(rows), 13)]
    got = {}
    for a, b, _, _, place, other, n in (r for t in jaccard._partial(iter(batches)) for r in zip(*[c.to_pylist() for c in t.columns], strict=True)):
        old = got.get((a, b), (0, 0, 0))
        got[a, b] = (max(old[0], place), max(old[1], other), old[2] + n)
    assert got == want


@pytest.mark.parametrize("meetings", [1, 7, jaccard.MEETINGS])
def test_meetings_of_differences(monkeypatch, meetings):
    monkeypatch.setattr(jaccard, "MEETINGS", meetings)
    rng = np.random.default_rng(8)
    unit = 2 * (100 + jaccard.LEVEL)
    costs, component = rng.integers(-3, 9, 30) * unit // 2, rng.integers(0, 12, 30)
    rows = []
    for gram in range(10):
        for low in sorted(rng.choice(30, 12, replace=False).tolist(), key=lambda x: int(costs[x])):
            rows.append((gram, low, 50, int(component[low]), int(costs[low]), int(rng.integers(1, 9)), int(component[low] != 0)))
    want = set()
    for g, a, _, mine, cost, room, seeks in rows:
        for h, b, _, theirs, other, their_room, _ in rows:
            if g == h and seeks and mine != theirs and max(1, -(-(cost + other) // unit)) <= min(room, their_room):
                want.add((min(a, b), max(a, b)))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 11], strict=True)], names=list("abcdefg")) for i in range(0, len(rows), 11)]
    got = {(a, b) for t in jaccard._meet(iter(batches)) for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)}
    assert got == want and len(want) > 20
