import math
import random

import pytest
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.operators import calibrate as K
from siftline.operators import explain as E
from siftline.operators import features as FT
from siftline.operators import metrics as M
from siftline.operators import models as MD
from siftline.operators import vectors as VC
from siftline.plans import queries_models as QM
from siftline.plans import training as TR
from siftline.plans.scoring import score_batch

rnd = random.Random(3)
GOOD, BAD = "team project office salary plan".split(), "urgent wire money quick fee".split()


def corpus(n=240):
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        words = rnd.choices(BAD if y else GOOD, k=6) + rnd.choices(GOOD + BAD, k=4)
        split = "train" if i % 10 < 6 else "val" if i % 10 < 8 else "test"
        rows.append((i, " ".join(words), y, split))
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(ROWS, "id long, text_all string, y int, split string")
    return TR.prepare(df, "id", "y", min_df=2)


def grams(text):
    w = text.split()
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_tfidf(texts, min_df, max_df):
    docs = {i: grams(t) for i, t in texts.items()}
    df = {}
    for g in docs.values():
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    vocab = {t: math.log((1 + len(docs)) / (1 + k)) + 1 for t, k in df.items() if k >= min_df and k <= max_df * len(docs)}
    out = {}
    for i, g in docs.items():
        w = {t: (1 + math.log(g.count(t))) * vocab[t] for t in set(g) if t in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(i, t): v / norm for t, v in w.items()}
    return vocab, out


def test_tfidf_equals_plain_loops(spark):
    texts = {i: t for i, t, _, _ in ROWS[:40]} | {99: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    vocab, weights = plain_tfidf(texts, 3, 0.9)
    found = FT.vocabulary(FT.ngram_rows(df, "t", "id"), df)
    assert {r.term: pytest.approx(r.idf) for r in found.collect()} == vocab
    got = {(r.id, r.term): r.weight for r in FT.tfidf(df, "t", "id", found).collect()}
    assert got == pytest.approx(weights)
    assert FT.vocabulary(FT.ngram_rows(df, "t", "id"), df, max_terms=5).count() == 5


def test_counting_terms_shuffles_nothing(spark):
    df = spark.createDataFrame([(1, "a bb cc bb cc")], "id long, t string")
    rows = FT.ngram_rows(df, "t", "id")
    assert {(r.term, r.tf) for r in rows.collect()} == {("bb", 2), ("cc", 2), ("bb cc", 2), ("cc bb", 1)}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in FT.standardize(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_vectors(data):
    assert VC.vector_width(data.rows) == data.features.width
    with pytest.raises(ValueError):
        VC.check_width(3, 4)
    row = data.rows.first()
    assert row.features.size == data.features.width
    assert math.sqrt(sum(v * v for v in row.tfidf.values)) == pytest.approx(1.0)
    vocab, weights = plain_tfidf({i: t for i, t, _, s in ROWS if s == "train"}, 2, 0.9)
    assert data.features.size == len(vocab)
    place = {r.idx: r.term for r in data.features.vocab.collect()}
    one = data.split("train").orderBy("id").first()
    got = {place[i]: v for i, v in zip(one.tfidf.indices, one.tfidf.values)}
    assert got == pytest.approx({t: w for (i, t), w in weights.items() if i == one.id})


def test_models_beat_the_prior_and_repeat(spark, data):
    train, val = data.split("train"), data.split("val")
    fits = [
        *MD.train_logistic(train, "y", [1.0], max_iter=25),
        *MD.train_logistic(train, "y", [10.0], "l1", max_iter=25),
        *MD.train_svm(train, "y", [1.0], max_iter=25),
        *MD.train_boosted_tabular(train, "y", {**C.BOOST_TABULAR, "n_estimators": [3]}),
    ]
    table = {r["name"]: r for r in M.tuned_metrics(MD.candidate_scores(val, fits, ["y"]), "y", "score", ["name"]).collect()}
    assert len(table) == 4
    for name in ("logistic_regression_C1.0", "logreg_l1_C10.0"):
        assert table[name]["brier"] < 0.25 * 0.75 and table[name]["roc_auc"] > 0.9
    again = MD.train_logistic(train, "y", [1.0], max_iter=25)[0]
    assert again.coefficients == pytest.approx(fits[0].coefficients)
    rows = fits[0].add_scores(data.rows, "raw", "p")
    held = rows.filter("split = 'val'")
    for model in K.fit_calibrators(held, "y", "raw"):
        out = sorted((r.raw, r.c) for r in model.apply(rows, "raw", "c").collect())
        assert all(0.0 <= c <= 1.0 for _, c in out)
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(out, out[1:]))
    with pytest.raises(ValueError):
        K.fit_calibrators(held, "y", "raw", ["beta"])


def test_grids():
    assert MD.expand_grid({"a": [1, 2], "b": 3, "c": ["x", "y"]}) == [
        {"a": 1, "c": "x", "b": 3}, {"a": 1, "c": "y", "b": 3}, {"a": 2, "c": "x", "b": 3}, {"a": 2, "c": "y", "b": 3}]
    assert len(MD.expand_grid(C.BOOST_FULL)) == 2187 and len(MD.boost_grid(4)) == 12
    assert [p["i"] for p in MD.thin_grid([{"i": i} for i in range(10)], 4)] == [0, 2, 5, 7]
    assert len(MD.weight_grid(2)) == 9 and len(MD.weight_grid(3)) == 66 and MD.weight_grid(1) == []
    trials = MD.log_uniform_trials(5, range(300, 1001, 100))
    assert trials == MD.log_uniform_trials(5, range(300, 1001, 100)) and all(0.01 <= t["C"] <= 100 for t in trials)


def test_ensemble_needs_a_strict_gain(spark):
    rows = [(1, 0.9, 0.9), (0, 0.1, 0.2), (1, 0.8, 0.7), (0, 0.3, 0.1)]
    out = MD.ensemble_search(spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"]).collect()
    assert len(out) == 10 and [r.mix for r in out if r.is_best] == [0]
    table = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.9), ("c", 2, 0.9), ("d", 3, float("nan"))], "name string, p int, f1 double")
    assert MD.select_best(table, "p").first()["name"] == "b"


MODEL = ([("urgent", 2.0, 3.0), ("wire money", 2.5, 2.0), ("office", 1.5, -2.0)], -0.5, {"text_length": (50.0, 10.0, 0.2)})


def test_score_and_explanations(spark):
    texts = {1: "Urgent urgent wire money office", 2: "office plan", 3: ""}
    model = FT.literal_model(spark, *MODEL)
    df = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "id long, title string, description string")
    out = {r.id: r for r in score_batch(df, "id", model, 0.5, text_fields=("title", "description")).collect()}
    w = {"urgent": (1 + math.log(2)) * 2.0, "wire money": 2.5, "office": 1.5}
    norm = math.sqrt(sum(v * v for v in w.values()))
    parts = {t: w[t] / norm * c for t, _, c in MODEL[0]} | {"text_length": 0.2 * (len(texts[1]) - 50) / 10}
    p = 1 / (1 + math.exp(-(-0.5 + sum(parts.values()))))
    assert out[1].probability_fraud == pytest.approx(p)
    assert out[1].decision == "fraud" and out[1].binary_label == 1
    assert [x.feature for x in out[1].top_positive] == ["urgent", "wire money"]
    assert {x.feature: pytest.approx(x.contribution) for x in out[1].top_negative} == {k: parts[k] for k in ("office", "text_length")}
    assert out[1].summary.startswith("Urgent and wire money pushed the score toward fraud; ")
    assert out[3].probability_fraud == pytest.approx(1 / (1 + math.exp(0.5 + 1.0)))
    assert out[3].summary == "Text length reinforced the legit decision."
    ready = FT.tabular_features(df.withColumn("text_all", F.lower("title")))
    local = {(r.id, r.feature): r.weight for r in E.local_surrogate(ready, "text_all", "id", model).collect()}
    assert local[1, "urgent"] > 0 > local[1, "office"]


def test_score_plan_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, title string, description string")
    out = score_batch(df, "id", FT.literal_model(spark, *MODEL), 0.5, explain=False, text_fields=("title", "description"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan  # a small model is applied where the text is read
    large = FT.literal_model(spark, [(f"w{i}", 1.0, 1.0) for i in range(400)], 0.0)
    plan = score_batch(df, "id", large, 0.5, explain=False, text_fields=("title", "description"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_terms_are_looked_up_inside_the_row(spark, monkeypatch):
    texts = [(1, "aa bb aa cc", 2.0), (1, "bb", 0.0), (2, "", 0.0), (3, None, 1.0), (4, "zz", 1.0)]
    df = spark.createDataFrame(texts, "id long, t string, text_length double")
    entries = [("aa", 2.0, 3.0), ("bb", 1.5, -2.0), ("aa bb", 1.25, 0.5), *[(f"w{i}", 1.0, 1.0) for i in range(400)]]
    vocab = spark.createDataFrame([(t, i) for t, i, _ in entries], "term string, idf double")
    got = sorted((r.id, r.term, r.tf, round(r.weight, 9)) for r in FT.tfidf(df, "t", "id", vocab).collect())
    w = {"aa": (1 + math.log(2)) * 2.0, "bb": 1.5, "aa bb": 1.25}
    norm = math.sqrt(sum(x * x for x in w.values()))
    want = [(1, t, 2 if t == "aa" else 1, round(x / norm, 9)) for t, x in w.items()]
    assert got == sorted([*want, (1, "bb", 1, 1.0)])  # a repeated key is two rows of unit length
    assert FT.tfidf(df.limit(0), "t", "id", vocab).count() == 0 and FT.tfidf(df, "t", "id", vocab.limit(0)).count() == 0

    model = FT.literal_model(spark, entries, 0.0, {"text_length": (1.0, 2.0, 4.0)})
    one = df.filter("t is null or t != 'bb'")
    probed = E.contribution_rows(one, "t", "id", model)
    monkeypatch.setattr(C, "MAX_VOCABULARY", 2)
    joined = E.contribution_rows(one, "t", "id", model)

    def values(rows):
        return sorted((r.id, r.feature, r.source, round(r.contribution, 9)) for r in rows.collect())

    assert values(probed) == values(joined) and (1, "aa", "token", round(w["aa"] / norm * 3.0, 9)) in values(probed)
    tops = [d._jdf.queryExecution().optimizedPlan().toString() for d in (probed, joined)]
    assert "RepartitionByExpression" not in tops[0] and "Join" not in tops[0].split("scalar-subquery")[0]
    assert "RepartitionByExpression" in tops[1]


def test_large_term_tables_are_counted_before_a_broadcast(spark, monkeypatch):
    model = FT.LinearModel(spark.createDataFrame(MODEL[0], "term string, idf double, coef double"), 0.0)
    rows = spark.createDataFrame([(1, "urgent", 1), (1, "none", 1)], "id long, term string, tf int")
    small = model.lookup(rows)
    monkeypatch.setattr(C, "MAX_VOCABULARY", 2)
    large = model.lookup(rows)
    assert "rightHint=(strategy=broadcast)" in small._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert small.collect() == large.collect()


def test_subwords(spark):
    pieces = [("[CLS]", 9.0), ("##x", 0.5), ("sal", 0.25), ("##ary", 0.5), ("", 1.0), ("▁", 1.0), ("▁re", 0.125), ("##mote", 0.25), ("[SEP]", 9.0)]
    df = spark.createDataFrame([(1, i, p, s) for i, (p, s) in enumerate(pieces)], "id int, at int, piece string, score double")
    out = E.merge_subwords(df, "id", "at", "piece", "score", ["[CLS]", "[SEP]"]).orderBy("word_no").collect()
    assert [(r.feature, r.contribution) for r in out] == [("x", 0.5), ("salary", 0.75), ("remote", 0.375)]


def test_token_frequency_and_mean_contributions(spark):
    df = spark.createDataFrame([("a a b", 0.9), ("b c", 0.2), ("c c", 0.1)], "t string, p double")
    got = {tuple(r) for r in E.token_frequency(df, "t", "p", 0.5, 1).collect()}
    assert got == {("a", 2, 0, 2), ("c", 0, 3, -3)}
    one = spark.createDataFrame([(1, "a", "token", 1.0)], f"id int, {E.CONTRIBUTION}")
    two = spark.createDataFrame([(1, "a", "token", 3.0), (1, "b", "token", 1.0)], f"id int, {E.CONTRIBUTION}")
    mean = {r.feature: r.contribution for r in E.mean_contributions([(one, 1.0), (two, 3.0)], "id").collect()}
    assert mean == {"a": 2.5, "b": 0.75}


def test_user_predictor_sees_whole_texts_in_batches(spark):
    def load():
        def predict(texts):
            assert len(texts) <= 3
            return [len(t) / 100 for t in texts]
        return predict

    df = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, t string")
    got = {r.id: r.probability for r in MD.score_with_predictor(df, "t", "id", load, 3).collect()}
    assert got == {i: i / 100 for i in range(20)}


def test_training_end_to_end(spark):
    df = spark.createDataFrame(ROWS, "id long, text_all string, y int, split string").withColumn("industry", (F.col("id") % 2).cast("string"))
    grids = TR.Grids(logistic=(1.0,), logistic_l1=(), svm=(1.0,), boosted={}, boosted_full_limit=0, max_iter=15)
    result = TR.train(df, "id", "y", grids, min_df=2)
    board = {r["name"]: r for r in result.leaderboard.collect()}
    assert set(board) >= {"logistic_regression_C1.0", "linear_svm_C1.0", "ensemble_mean"}
    assert result.best_name in board and board[result.best_name]["test_roc_auc"] > 0.85
    tested = result.test_predictions()
    assert tested.count() == sum(s == "test" for *_, s in ROWS)
    tables = TR.report_tables(result, df.select("id", "text_all", "industry"), "id", ["industry"], 5)
    assert tables["threshold_metrics"].count() == 19 and tables["slice_metrics"].count() == 2
    assert tables["metrics_summary"].count() == 2


def test_evaluate_candidates_fits_the_published_grids(monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def train(df, key, label, grids=None, **options):
        seen["grids"] = grids or TR.Grids()
        raise Stop

    monkeypatch.setattr(QM, "_rows", lambda spark, sf: None)
    monkeypatch.setattr(TR, "train", train)
    with pytest.raises(Stop):
        QM.evaluate_candidates(None, "")
    assert seen["grids"] == TR.Grids()
    assert seen["grids"].boosted["n_estimators"] == [800] and seen["grids"].boosted_full_limit == 12


def test_boosted_queries_fit_the_published_grids(monkeypatch):
    seen = []
    rows = type("Rows", (), {"split": lambda self, name: name, "first": lambda self: {"scale_pos_weight": 4}})()
    monkeypatch.setattr(QM, "_data", lambda spark, sf: rows)
    monkeypatch.setattr(QM, "_evaluate", lambda data, candidates: None)
    monkeypatch.setattr(MD, "class_weights", lambda df, label: rows)
    monkeypatch.setattr(MD, "train_boosted_tabular", lambda train, label, settings=C.BOOST_TABULAR: seen.append(settings))
    monkeypatch.setattr(MD, "train_boosted_full", lambda train, val, label, grid, **options: seen.append((grid, options)))
    QM.train_gbt_tabular(None, "")
    QM.train_gbt_full(None, "")
    assert seen == [C.BOOST_TABULAR, (MD.boost_grid(4), {})]


def test_boosted_full_uses_every_column(spark):
    from pyspark.ml.linalg import Vectors

    width = 602
    rows = [(Vectors.sparse(width, {i % width: 1.0}), int(i % 4 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, ["features", "y"])
    df = df.withMetadata("features", {"ml_attr": {"num_attrs": width}})
    grid = [{**MD.boost_grid(4)[0], "max_depth": 2, "n_estimators": 1}]
    model = MD.train_boosted_full(df, df, "y", grid)[0]
    assert model.width == width
    assert model.add_scores(df, "raw", "score").count() == 60
