"""End-to-end training: features, candidate grids, calibration, ensembles, report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.operators import calibrate as K
from siftline.operators import metrics as M
from siftline.operators import models as MD
from siftline.operators.features import tabular_columns, tabular_features
from siftline.operators.policy import gray_zone
from siftline.operators.vectors import FeatureModel, fit_features
from siftline.session import scratch_path


# Training rows a task of an iterative fit should have at least.
ROWS_PER_TASK = 2000


@dataclass
class Prepared:
    """Fitted features and the vectors of every split."""

    features: FeatureModel
    rows: DataFrame
    label: str

    def split(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name)

    def release(self) -> None:
        self.rows.unpersist()


def prepare(
    df: DataFrame,
    key: str,
    label: str,
    text: str = "text_all",
    keep: Sequence[str] = (),
    terms: Sequence[str] = C.SCAM_TERMS,
    **vocabulary,
) -> Prepared:
    """Features fitted on the training rows and vectors for all rows, kept for the fits.

    `df` holds `split`. Its texts and tabular features are written, as the passes for words and vectors
    both read them. The vectors spill to disk rather than being computed again by
    each iteration; a lost executor recomputes only its own share.
    """
    names = list(tabular_columns(df.columns, text, terms))
    plain = tabular_features(df, text=text, terms=terms)
    at = scratch_path(df.sparkSession, "ready")
    plain.select(*dict.fromkeys([key, label, "split", text, *keep, *names])).write.parquet(at)
    ready = df.sparkSession.read.parquet(at)
    train, measured = (x.filter(F.col("split") == "train") for x in (ready, plain))
    fitted = fit_features(train, text, key, names, **vocabulary, measured=measured)
    rows = fitted.transform(ready, [label, "split", *keep])
    # counted on the plain rows, before any text work
    weights = MD.class_weights(ready.filter(F.col("split") == "train"), label).first()
    size = weights["pos"] + weights["neg"]
    rows = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), size // ROWS_PER_TASK)))
    weight = F.when(F.col(label) == 1, weights["weight_pos"]).otherwise(weights["weight_neg"])
    rows = rows.withColumn("weight", weight).persist(StorageLevel.MEMORY_AND_DISK)
    return Prepared(fitted, rows, label)


@dataclass
class Grids:
    """Which candidates to fit; the defaults are the full published grids."""

    logistic: Sequence[float] = C.LOGREG_CS
    logistic_l1: Sequence[float] = C.LOGREG_CS
    svm: Sequence[float] = C.SVM_CS
    boosted: dict = field(default_factory=lambda: dict(C.BOOST_TABULAR))
    boosted_full: dict = field(default_factory=lambda: dict(C.BOOST_FULL))
    boosted_full_limit: int = C.BOOST_MAX_VARIANTS
    max_iter: int | None = None


def train_candidates(data: Prepared, grids: Grids) -> list[MD.Candidate]:
    """Every candidate of the grids, in the order that breaks ties."""
    train, label = data.split("train"), data.label
    out = []
    if grids.logistic:
        out += MD.train_logistic(train, label, grids.logistic, "l2", grids.max_iter)
    if grids.logistic_l1:
        out += MD.train_logistic(train, label, grids.logistic_l1, "l1", grids.max_iter)
    if grids.svm:
        out += MD.train_svm(train, label, grids.svm, grids.max_iter or C.SVM_ITER)
    if grids.boosted:
        out += MD.train_boosted_tabular(train, label, grids.boosted)
    if grids.boosted_full_limit > 0:
        weight = MD.class_weights(train, label).first()["scale_pos_weight"]
        grid = MD.boost_grid(weight, grids.boosted_full, grids.boosted_full_limit)
        out += MD.train_boosted_full(train, data.split("val"), label, grid)
    return out


def calibrated_scores(
    data: Prepared,
    candidates: Sequence[MD.Candidate],
    keep: Sequence[str] = (),
    methods: Sequence[str] = ("platt", "isotonic"),
) -> tuple[DataFrame, dict[str, object]]:
    """Validation and test rows with one calibrated score column `s<i>` per candidate.

    Calibrators of all candidates are fitted together on the validation rows; the better one of each by
    (Brier, ECE) is used.
    """
    label = data.label
    held = data.rows.filter(F.col("split") != "train")
    held = MD.add_scores(held, candidates, [(f"r{i}", f"u{i}") for i in range(len(candidates))])
    columns = [data.features.key, label, "split", *keep]
    columns += [f"{p}{i}" for i in range(len(candidates)) for p in "ru"]
    # Written, so that no later job scores again and nothing stays in memory.
    at = scratch_path(held.sparkSession, "scores")
    held.select(*columns).write.parquet(at)
    held = held.sparkSession.read.parquet(at)
    val = held.filter(F.col("split") == "val")
    raw = long_scores(val, data.features.key, label, {c.name: f"r{i}" for i, c in enumerate(candidates)})
    fitted = K.fit_all_calibrators(raw, "name", "label", "score", methods)
    trial, tried = val, {}
    for i, c in enumerate(candidates):
        for method, model in fitted.get(c.name, {}).items():
            tried[c.name, method] = f"_{method}{i}"
            trial = model.apply(trial, f"r{i}", tried[c.name, method])
    best = K.choose_all(trial, label, tried) if tried else {}
    chosen, out = {}, held
    for i, c in enumerate(candidates):
        if c.name not in best:  # no validation rows: the probability stays as it is
            out = out.withColumn(f"s{i}", F.col(f"u{i}"))
            continue
        chosen[c.name] = fitted[c.name][best[c.name]]
        out = chosen[c.name].apply(out, f"r{i}", f"s{i}")
    return out, chosen


@dataclass
class TrainingResult:
    """Tables and models of a training run."""

    features: FeatureModel
    candidates: list[MD.Candidate]
    calibrators: dict[str, object]
    scores: DataFrame
    leaderboard: DataFrame
    ensembles: DataFrame | None
    best_name: str
    best_threshold: float

    def test_predictions(self, width: float = C.GRAY_WIDTH) -> DataFrame:
        """(prob_fraud, label, decision) of the winner on the test rows."""
        rows = self.scores.filter((F.col("split") == "test") & (F.col("name") == self.best_name))
        return rows.select(
            F.col("score").alias("prob_fraud"),
            F.col("label"),
            gray_zone("score", self.best_threshold, width).alias("decision"),
        )


def long_scores(wide: DataFrame, key: str, label: str, columns: dict[str, str], keep=()) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(c).alias("score")) for n, c in columns.items()]
    )
    rows = wide.select(key, F.col(label).alias("label"), "split", *keep, F.explode(cells).alias("_c"))
    return rows.select(key, "label", "split", *keep, "_c.*")


def train(
    df: DataFrame,
    key: str,
    label: str,
    grids: Grids | None = None,
    *,
    retune: bool = True,
    keep: Sequence[str] = (),
    **options,
) -> TrainingResult:
    """Fit the grids, calibrate, tune thresholds, search ensembles, choose the winner.

    Thresholds are tuned on calibrated validation scores; `retune=False` tunes them on the
    uncalibrated ones. All candidates are evaluated by one job over one long table.
    """
    data = prepare(df, key, label, keep=keep, **options)
    candidates = train_candidates(data, grids or Grids())
    wide, calibrators = calibrated_scores(data, candidates, keep)
    data.release()
    scores = long_scores(wide, key, label, {c.name: f"s{i}" for i, c in enumerate(candidates)}, keep)
    if retune:
        tuned = scores
    else:
        tuned = long_scores(wide, key, label, {c.name: f"u{i}" for i, c in enumerate(candidates)}, keep)
    thresholds = M.best_threshold(tuned.filter("split = 'val'"), "label", "score", ["name"])
    table = _leaderboard(scores, thresholds, {c.name: i for i, c in enumerate(candidates)})

    # one row per candidate from here on
    ranked = table.orderBy(F.col("val_f1").desc(), "position").limit(3).collect()
    ensembles = None
    if len(ranked) >= 2:
        position = {c.name: i for i, c in enumerate(candidates)}
        columns = [f"s{position[r['name']]}" for r in ranked]
        ensembles = MD.ensemble_search(wide.filter("split = 'val'"), label, columns)
        mixes = ensembles.filter("mix = 0 OR is_best").collect()
        extra = {}
        for row in mixes:
            weights = [row[f"w{i + 1}"] for i in range(len(columns))]
            name = "ensemble_mean" if row["mix"] == 0 else "ensemble_weighted"
            extra[name] = MD.mix(columns, [F.lit(w) for w in weights])
        mixed = wide.withColumns({f"e_{n}": c for n, c in extra.items()})
        more = long_scores(mixed, key, label, {n: f"e_{n}" for n in extra}, keep)
        scores = scores.unionByName(more)
        best = M.best_threshold(more.filter("split = 'val'"), "label", "score", ["name"])
        place = {n: len(candidates) + i for i, n in enumerate(extra)}
        table = table.unionByName(_leaderboard(more, best, place))
    winner = MD.select_best(table, "position", "val_f1").first()
    return TrainingResult(
        data.features, candidates, calibrators, scores, table, ensembles,
        winner["name"], float(winner["threshold"]),
    )


def _leaderboard(scores: DataFrame, thresholds: DataFrame, position: dict[str, int]) -> DataFrame:
    """(name, position, threshold, val_*, test_*), one row per candidate."""
    spark = scores.sparkSession
    rows = scores.join(F.broadcast(thresholds.select("name", "threshold")), "name")
    m = M.all_metrics(rows, "label", "score", F.col("threshold"), ["name", "threshold", "split"])
    wide = m.groupBy("name", "threshold").agg(
        *[
            F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
            for s in ("val", "test")
            for c in C.METRICS
        ]
    )
    places = spark.createDataFrame(list(position.items()), "name string, position int")
    return wide.join(F.broadcast(places), "name")


def report_tables(
    result: TrainingResult, text: DataFrame, key: str, slice_columns: Sequence[str] = C.CATEGORY_FIELDS,
    min_count: int = C.SLICE_MIN_COUNT,
) -> dict[str, DataFrame | None]:
    """The report of a run: sweep, regression, slices, summary, top terms.

    `text` holds (key, text_all) and the slice columns.
    """
    mine = result.scores.filter(F.col("name") == result.best_name)
    val, test = (mine.filter(F.col("split") == s) for s in ("val", "test"))
    joined = test.join(text, key)
    t = result.best_threshold
    linear = [c for c in result.candidates if c.coefficients is not None]
    terms = None
    if linear:
        table = result.features.coefficients(linear[0].coefficients)
        terms = table.filter("source = 'token'").select(F.col("feature").alias("term"), "coef")
    from siftline.operators.explain import token_frequency, top_terms

    return {
        "threshold_metrics": M.threshold_sweep(val, "label", "score"),
        "probability_regression": M.probability_regression(
            joined.withColumn("n", F.length("text_all")), "n", "score"
        ),
        "top_terms": None if terms is None else top_terms(terms, 30),
        "token_frequency_analysis": token_frequency(joined, "text_all", "score", t),
        "slice_metrics": M.slice_metrics(joined, "label", "score", t, slice_columns, min_count),
        "metrics_summary": M.all_metrics(
            mine.filter("split <> 'train'"), "label", "score", t, ["split"]
        ),
        "leaderboard": result.leaderboard,
    }
