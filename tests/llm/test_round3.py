"""Toxicity, hard negatives and periodic runs against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import packed_products as pp
from siftline.llm import runs
from siftline.llm import toxicity as tx
from tests.llm.test_llm import AWKWARD, DOCS, awkward, by_repr, nothing  # noqa: F401

FOLDER = "/root/testdata/sf0.001"

# --- Periodic runs


def plain_runs(t):
    """Every run of at least two smallest periods, by comparing word for word."""
    out = []
    for q in range(1, len(t) // 2 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            n = j + q - i
            smaller = (all(t[k] == t[k + p] for k in range(i, i + n - p)) for p in range(1, q))
            if j > i and n >= 2 * q and not any(smaller):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(key, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = [r for r in plain_runs(words) if r[1] >= max(24, 3 * r[2])]
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = (*best, int(Fraction(1000 * best[1], best[2]))) if best else (None,) * 4
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (key, len(found), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=45))
def test_all_runs_equal_plain(t):
    assert runs.all_runs(t) == plain_runs(t)


def test_runs_with_the_filter_equal_plain():
    rng = random.Random(5)
    for _ in range(300):
        n, k = rng.randrange(0, 260), rng.choice([1, 2, 3, 30])
        t = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 30 else 0):
            p, a = rng.randrange(1, 30), rng.randrange(n)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 6) + rng.randrange(5))):
                t[i] = t[i - p]
        for least, times in ((24, 3), (10, 2), (6, 4)):
            want = [r for r in plain_runs(t) if r[1] >= max(least, times * r[2])]
            assert runs.runs(np.array(t, np.int64), least, times) == want


def test_common_extensions_equal_plain():
    rng = random.Random(3)
    t = [rng.randrange(1, 3) for _ in range(200)]
    ext = runs.Extensions(t)
    a, b = np.array([(i, j) for i in range(200) for j in range(200) if i != j]).T
    for i, j, got in zip(a.tolist(), b.tolist(), ext.common(a, b).tolist(), strict=True):
        want = 0
        while max(i, j) + want < 200 and t[i + want] == t[j + want]:
            want += 1
        assert got == want


def test_long_run_is_found_whole():
    t = np.arange(60_000) % 9973
    assert runs.runs(t) == [(0, 60_000, 9973)]


def test_op13_equals_plain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 6000)
    got = sorted(map(tuple, runs.find_runs(docs, change=runs.planted).collect()))
    assert got == sorted(plain_report(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_awkward_rows(spark, awkward, nothing):  # noqa: F811
    short = awkward.filter((F.length("text") < 20_000) | F.col("text").isNull())
    got = runs.find_runs(short, change=runs.planted)
    assert by_repr(got.collect()) == by_repr(plain_report(r.doc_id, r.text) for r in short.collect())
    assert runs.find_runs(nothing).columns == got.columns and runs.find_runs(nothing).count() == 0
    whole = {r.doc_id: r for r in runs.find_runs(awkward).collect()}
    assert whole[11].period == 9973 and whole[10].period == 1 and whole[10].length == 3000


# --- Hard negatives


def plain_negatives(rows, asks):
    out = []
    for own, label, a in {(i, y, tuple(v)) for i, y, v in rows if asks(i)}:
        dot = lambda v, a=a: sum(int(np.floor(256 * x)) * int(np.floor(256 * z)) for x, z in zip(a, v, strict=True))
        scored = sorted((-dot(v), i, y) for i, y, v in rows if i != own)
        for s, i, _ in [r for r in scored if r[2] == label][: pp.POSITIVES]:
            near = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][: pp.NEGATIVES]
            out += [(own, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 300, 2**20, 2**40])
def test_packed_products_are_exact(scale):
    rng = np.random.default_rng(scale)
    a, r = rng.integers(-scale, scale, (7, 11)), rng.integers(-scale // 3 - 1, scale, (101, 11))
    packed = pp.Packed(r)
    for by in (1, 3, 9):  # the same rows for wider and narrower anchors
        want = [[sum(int(x) * int(y) * by for x, y in zip(p, q, strict=True)) for q in r] for p in a]
        assert packed.products(a * by).tolist() == want
    shifted = pp.Packed(r + 2**45).products(a + 2**50).tolist()
    assert shifted == [[sum((int(x) + 2**50) * (int(y) + 2**45) for x, y in zip(p, q, strict=True)) for q in r] for p in a]


def test_fields_hold_several_candidates():
    rng = np.random.default_rng(0)
    packed = pp.Packed(rng.integers(-128, 128, (1000, 64)))
    packed.products(rng.integers(-128, 128, (5, 64)))
    assert packed.wide.shape == (64, 500)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, v string, shard string, anchor string")


def test_mined_rows_equal_plain(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(400)]
    rows += rows[:40]  # repeated rows, anchors among them
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(30)]  # ties
    odd = [(20, None, rows[0][2]), (None, 1, rows[0][2]), (30, 1, None), (40, 1, [float("nan")] * 6), (50, 1, [1.0, None] * 3),
           (60, 1, [float("inf")] * 6), (70, 1, [1.0]), (80, 2, [])]
    df = frame(spark, [(*r, "a", "b", "c") for r in rows + odd])
    got = sorted(map(tuple, pp.mine(pp.usable(df), F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 500
    small = pp.mine(pp.usable(df.filter("vec_id < 4")), F.col("vec_id") == 0)
    assert sorted(map(tuple, small.collect())) == plain_negatives([r for r in rows if r[0] < 4], lambda i: i == 0)
    none = pp.mine(pp.usable(df.limit(0)), F.col("vec_id") == 0)
    assert none.count() == 0 and none.columns == [c.split()[0] for c in pp.ROWS.split(", ")]


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(x) for x in np.float32(rng.normal(size=4) * 2.0**18)]) for i in range(40)]
    got = sorted(map(tuple, pp.mine(pp.usable(frame(spark, [(*r, "", "", "") for r in rows])), F.col("vec_id") < 3).collect()))
    assert got == plain_negatives(rows, lambda i: i < 3) and got
    huge = frame(spark, [(*r, "", "", "") for r in rows] + [(99, 1, [3e38, 1.0, 1.0, 1.0], "", "", "")])
    assert pp.mine(pp.usable(huge), F.col("vec_id") < 3).count() > 0


def test_op12_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got = sorted(map(tuple, pp.op12(spark, FOLDER).collect()))
    assert got == sorted(con.execute(pp.SQL).fetchall()) and got


# --- Toxicity


def test_isotonic_equals_plain():
    rng = np.random.default_rng(2)
    for _ in range(30):
        raw = rng.integers(0, 12, 40).astype(float)
        y = (rng.random(40) < raw / 12).astype(float)
        score = np.unique(raw)
        sums = [(y[raw == s].sum(), (raw == s).sum()) for s in score]
        # The pooled mean at k is the largest over starts of the smallest over ends of the means between.
        mean = lambda a, b, sums=sums: sum(s for s, _ in sums[a : b + 1]) / sum(n for _, n in sums[a : b + 1])
        want = [max(min(mean(a, b) for b in range(k, len(score))) for a in range(k + 1)) for k in range(len(score))]
        assert np.allclose(tx.isotonic(raw, y)(score), want)


def test_first_tree_is_the_best_split():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 20, (300, 3)).astype(float)
    y = ((x[:, 1] > 12) ^ (rng.random(300) < 0.1)).astype(float)
    trees = tx.boost(x, y)
    p = np.full(300, y.mean())
    g, h = p - y, p * (1 - p)

    def gain(j, cut):
        low = x[:, j] <= cut
        part = lambda at: g[at].sum() ** 2 / (h[at].sum() + tx.PENALTY)
        return part(low) + part(~low)

    best = max((gain(j, c), j, c) for j in range(3) for c in np.unique(x[:, j])[:-1])
    assert (trees.feature[0, 0], trees.cut[0, 0]) == best[1:]
    loss = lambda s: -np.mean(np.log(np.where(y > 0, tx._sigmoid(s), 1 - tx._sigmoid(s))))
    assert loss(trees.score(x)) < 0.5 * loss(np.full(300, trees.base))


def test_features_by_hand():
    known = tx.lexicon(np.sort(tx._hash_of(["idiot", "scum"])), np.array([4.0, 4.0]))
    texts = ["You are an IDIOT!!", "i.d.i.o.t and $cum", "fine words here", None, "", "  ", "you a b c d e f idiot", "sooooo 1diot"]
    rows = {t: dict(zip(tx.NAMES, r, strict=True)) for t, r in zip(texts, tx.features(pa.array(texts), known).tolist(), strict=True)}
    one = rows[texts[0]]
    assert one["telling"] == one["strong"] == 0.25 and one["near"] == 0.25 and one["second"] == 0.25
    assert one["shouted"] == 0.25 and one["marks"] == one["shouts"] == 2 / 15 and one["repeated_marks"] == 1 / 15
    assert rows[texts[1]]["hidden_words"] == pytest.approx(np.log1p(2)) and rows[texts[1]]["masked"] == 1 / 3
    assert rows[texts[6]]["telling"] > 0 and rows[texts[6]]["near"] == 0
    assert rows[texts[7]]["stretched"] == 0.5 and rows[texts[7]]["mixed"] == 0.5 and rows[texts[7]]["hidden_words"] > 0
    assert not any(rows[None].values()) and not any(rows[""].values()) and not any(rows["  "].values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA1é!. \n$x", max_size=30)), min_size=1, max_size=8))
def test_features_do_not_depend_on_the_batch(texts):
    known = tx.lexicon(tx._hash_of(["aa", "ax"]), np.array([2.0, 4.0]))
    together = tx.features(pa.array(texts, pa.string()), known)
    alone = np.concatenate([tx.features(pa.array([t], pa.string()), known) for t in texts])
    assert np.array_equal(together, alone)


def test_lexicon_of_a_fold_knows_nothing_of_it():
    keys = np.array([5, 9], np.uint64)
    counts = np.zeros((2, 2 * tx.FOLDS))
    counts[0, 1] = 50  # only in toxic rows of the first fold
    counts[1, 1::2] = 20
    out = tx.lexicons(keys, counts, np.array([500, 60] * tx.FOLDS, float))
    assert out[0].keys.tolist() == [9] and out[1].keys.tolist() == [5, 9] and out[-1].keys.tolist() == [5, 9]


def test_held_out_toxic_rows_are_found(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = tx.op11(spark, folder).filter("held_out").join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert got[got.toxic == 1].predicted.mean() > 0.9 and got[got.toxic == 0].predicted.mean() < 0.01
    assert ((got.score - got.toxic) ** 2).mean() < 0.02


def test_labels_held_out_do_not_count(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} idiot you" if i % 3 == 0 else f"word{i % 7} fine") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    lied = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.score(docs, tx.train(docs, x.filter(~tx.held_out()))).orderBy("doc_id").collect() for x in (labels, lied))
    assert a == b and {r.toxic for r in a if r.doc_id % 3 == 0} == {1} and {r.toxic for r in a if r.doc_id % 3} == {0}


def test_toxicity_of_awkward_rows(spark, awkward, nothing):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(None, 1), (3, None), (4, 7), (5, 0), (5, 1)], "doc_id long, toxic int")
    model = tx.train(awkward, labels)
    got = tx.score(awkward.withColumn("toxic", F.lit("x")), model)
    assert got.columns == [*awkward.columns, "toxicity", "toxic"] and got.count() == awkward.count()
    assert all(0 <= r.toxicity <= 1 for r in got.collect())
    empty = tx.train(nothing, labels)
    assert {r.toxicity for r in tx.score(awkward, empty).collect()} == {0.0}
    assert tx.score(nothing, model).count() == 0
    one = tx.train(awkward, labels.withColumn("toxic", F.lit(1)))
    assert {r.toxic for r in tx.score(awkward, one).collect()} == {1}
    assert DOCS and AWKWARD
