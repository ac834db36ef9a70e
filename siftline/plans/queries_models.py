"""Model fits, calibration, search, selection and scoring with a user's predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import calibrate as K
from siftline.operators import metrics as M
from siftline.operators import models as MD
from siftline.operators import vectors as VC
from siftline.operators.split import stratified_split
from siftline.plans import training as TR
from siftline.plans.catalog import query, rounded
from siftline.sources import views as V

Y = "fraudulent"


def _rows(spark, sf):
    """All labelled documents, cleaned and split."""
    docs = V.postings(spark, sf).join(V.labels(spark, sf), "doc_id")
    return stratified_split(V.cleaned(spark, sf, docs), "doc_id", Y)


def _data(spark, sf):
    return TR.prepare(_rows(spark, sf), "doc_id", Y, terms=V.VIEW_PHRASES)


def _evaluate(data, candidates):
    """Validation metrics per candidate, in grid order."""
    scores = MD.candidate_scores(data.split("val"), candidates, [Y])
    return rounded(M.tuned_metrics(scores, Y, "score", ["name"]))


@query("assemble_features")
def assemble_features(spark, sf):
    data = _data(spark, sf)
    width = data.features.width
    return data.rows.select(
        "doc_id", "split", F.lit(width).alias("width"), F.col("features").cast("string").alias("features")
    )


@query("validate_model_width")
def validate_model_width(spark, sf):
    """Width declared by the vectors against width of the fitted model."""
    data = _data(spark, sf)
    model = MD.train_logistic(data.split("train"), Y, [1.0])[0]
    declared = VC.vector_width(data.rows)
    VC.check_width(model.width, declared)
    return data.rows.groupBy("split").agg(
        F.count("*").alias("rows"), F.lit(declared).alias("declared"), F.lit(model.width).alias("expected")
    )


@query("train_logreg_l2")
def train_logreg_l2(spark, sf):
    data = _data(spark, sf)
    return _evaluate(data, MD.train_logistic(data.split("train"), Y))


@query("train_logreg_l1")
def train_logreg_l1(spark, sf):
    data = _data(spark, sf)
    return _evaluate(data, MD.train_logistic(data.split("train"), Y, penalty="l1"))


@query("train_svm")
def train_svm(spark, sf):
    data = _data(spark, sf)
    return _evaluate(data, MD.train_svm(data.split("train"), Y))


@query("train_gbt_tabular")
def train_gbt_tabular(spark, sf):
    data = _data(spark, sf)
    return _evaluate(data, MD.train_boosted_tabular(data.split("train"), Y))


@query("train_gbt_full")
def train_gbt_full(spark, sf):
    data = _data(spark, sf)
    weight = MD.class_weights(data.split("train"), Y).first()["scale_pos_weight"]
    grid = MD.boost_grid(weight)
    return _evaluate(data, MD.train_boosted_full(data.split("train"), data.split("val"), Y, grid))


@query("random_search")
def random_search(spark, sf):
    data = _data(spark, sf)
    return rounded(MD.random_search(data.split("train"), data.split("val"), Y))


def _raw_scores(spark, sf):
    data = _data(spark, sf)
    best = MD.train_logistic(data.split("train"), Y, [1.0])[0]
    return best.add_scores(data.rows, "raw", "score").select("doc_id", "split", Y, "raw", "score")


@query("calibrate_platt")
def calibrate_platt(spark, sf):
    rows = _raw_scores(spark, sf)
    model = K.fit_platt(rows.filter("split = 'val'"), Y, "raw")
    return rounded(model.apply(rows, "raw", "calibrated"))


@query("calibrate_isotonic")
def calibrate_isotonic(spark, sf):
    rows = _raw_scores(spark, sf)
    model = K.fit_isotonic(rows.filter("split = 'val'"), Y, "raw")
    return rounded(model.apply(rows, "raw", "calibrated"))


@query("evaluate_candidates")
def evaluate_candidates(spark, sf):
    """Training end to end with the published grids: the leaderboard with validation and test metrics."""
    return rounded(TR.train(_rows(spark, sf), "doc_id", Y, TR.Grids(), terms=V.VIEW_PHRASES).leaderboard)


def load_word_predictor():
    """A predictor any Python callable could stand in for: share of insult words."""
    import re

    words = {t for t, _, c in V.MODEL_TERMS if c > 3}
    pattern = re.compile(r"\w{2,}")

    def predict(texts):
        for text in texts:
            found = pattern.findall(text.lower())
            hits = sum(w in words for w in found)
            yield hits / (hits + 2.0)

    return predict


@query("score_with_predictor")
def score_with_predictor(spark, sf):
    docs = V.table(spark, sf, "documents")
    return rounded(MD.score_with_predictor(docs, "text", "doc_id", load_word_predictor))
