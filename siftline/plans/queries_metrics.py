"""Metrics, curves, slices, decisions, calibration choice and ensembles on given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions import scalars as N
from siftline.operators import calibrate as K
from siftline.operators import metrics as M
from siftline.operators import models as MD
from siftline.operators import monitor as MO
from siftline.operators import policy as D
from siftline.operators import states as ST
from siftline.operators.prefix import cumulative_counts
from siftline.operators.review import apply_feedback
from siftline.plans import sql_parts as Q
from siftline.plans.catalog import query, rounded
from siftline.session import scratch_path
from siftline.sources import views as V

Y, S, T = "fraudulent", "probability", V.THRESHOLD
_CUM = f"WITH {Q.LABELLED},{Q.cumulative('labelled', Y, S)}"


def _l(spark, sf):
    return V.labelled(spark, sf)


# --- whole table ---------------------------------------------------------------------


@query(
    "score_cumulative",
    f"""{_CUM} SELECT score, pos, neg, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg FROM cum""",
)
def score_cumulative(spark, sf):
    return cumulative_counts(_l(spark, sf), Y, S).select("score", "pos", "neg", "cum_pos", "cum_neg")


@query(
    "score_cumulative_events",
    f"""WITH {Q.PREDICTIONS},{Q.cumulative("(SELECT *, CAST(model_version = 'error' AS INTEGER) AS y FROM predictions)", 'y', 'probability')}
    SELECT score, pos, neg, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg FROM cum""",
)
def score_cumulative_events(spark, sf):
    df = V.predictions(spark, sf).withColumn("y", (F.col("model_version") == "error").cast("int"))
    return cumulative_counts(df, "y", "probability").select("score", "pos", "neg", "cum_pos", "cum_neg")


_CM = f"""WITH {Q.LABELLED}, cm AS (SELECT
  count(*) FILTER (WHERE fraudulent = 0 AND probability < 0.5) AS tn, count(*) FILTER (WHERE fraudulent = 0 AND probability >= 0.5) AS fp,
  count(*) FILTER (WHERE fraudulent = 1 AND probability < 0.5) AS fn, count(*) FILTER (WHERE fraudulent = 1 AND probability >= 0.5) AS tp
  FROM labelled)"""


@query("confusion_matrix", f"{_CM} SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_l(spark, sf), Y, S, T)


@query(
    "confusion_normalized",
    f"""{_CM} SELECT round(CAST(tn AS DOUBLE) / greatest(tn + fp, 1e-9), 6) AS tn, round(CAST(fp AS DOUBLE) / greatest(tn + fp, 1e-9), 6) AS fp,
    round(CAST(fn AS DOUBLE) / greatest(fn + tp, 1e-9), 6) AS fn, round(CAST(tp AS DOUBLE) / greatest(fn + tp, 1e-9), 6) AS tp FROM cm""",
)
def confusion_normalized(spark, sf):
    return rounded(M.confusion_shares(M.confusion_matrix(_l(spark, sf), Y, S, T)))


@query("prf", f"{_CM} SELECT {Q.prf('tp', '(tp + fp)', '(tp + fn)')} FROM cm")
def prf(spark, sf):
    return rounded(M.precision_recall_f1(_l(spark, sf), Y, S, T))


@query("brier", f"WITH {Q.LABELLED} SELECT round(avg((probability - fraudulent) * (probability - fraudulent)), 6) AS brier FROM labelled")
def brier(spark, sf):
    return rounded(M.brier(_l(spark, sf), Y, S))


@query("roc_auc", f"{_CUM} SELECT round({Q.AUC}, 6) AS roc_auc FROM cum")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(_l(spark, sf), Y, S))


@query("average_precision", f"{_CUM} SELECT round({Q.AP}, 6) AS pr_auc FROM cum")
def average_precision(spark, sf):
    return rounded(M.average_precision(_l(spark, sf), Y, S))


_BEST = """SELECT greatest(least(score, 1 - 1e-6), 1e-6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT score, 2.0 * cum_pos / (all_pos + cum_pos + cum_neg) AS f1 FROM cum ORDER BY 2 DESC, 1 LIMIT 1)"""


@query("best_threshold", f"{_CUM} {_BEST}")
def best_threshold(spark, sf):
    return rounded(M.best_threshold(_l(spark, sf), Y, S))


@query(
    "tuned_metrics",
    f"""{_CUM}, t AS ({_BEST}) SELECT threshold, {Q.metrics('(SELECT threshold FROM t)')} FROM cum, t GROUP BY threshold""",
)
def tuned_metrics(spark, sf):
    return rounded(M.tuned_metrics(_l(spark, sf), Y, S))


def _bin(x: str, bins: int) -> str:
    return " + ".join(f"CAST({x} >= {e!r} AS INTEGER)" for e in M.unit_edges(bins)) + " - 1"


def _ece(source: str, label: str, score: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}coalesce(sum(abs(s - y) * n) FILTER (WHERE bin BETWEEN 0 AND 14), 0.0) / sum(n) AS ece FROM (
      SELECT {keys}{_bin(score, 15)} AS bin, count(*) AS n, avg({score}) AS s, avg({label}) AS y FROM {source} GROUP BY ALL) {group}"""


@query("ece", f"WITH {Q.LABELLED} SELECT round(ece, 6) AS ece FROM ({_ece('labelled', Y, S)})")
def ece(spark, sf):
    return rounded(M.expected_calibration_error(_l(spark, sf), Y, S))


@query(
    "pr_curve",
    f"""{_CUM} SELECT score AS threshold, {Q.r6(Q.ratio('cum_pos', 'cum_pos + cum_neg'))} AS precision, {Q.r6(Q.ratio('cum_pos', 'all_pos'))} AS recall FROM cum
    UNION ALL SELECT NULL, 1.0, 0.0""",
)
def pr_curve(spark, sf):
    return rounded(M.pr_curve(_l(spark, sf), Y, S))


@query(
    "threshold_sweep",
    f"""WITH {Q.LABELLED}, g(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in C.SWEEP_POINTS)}),
    n AS (SELECT t, count(*) FILTER (WHERE fraudulent = 1 AND probability >= t) AS tp,
      count(*) FILTER (WHERE fraudulent = 0 AND probability >= t) AS fp, count(*) FILTER (WHERE fraudulent = 1) AS p FROM labelled, g GROUP BY t)
    SELECT t AS threshold, {Q.prf('tp', '(tp + fp)', 'p')} FROM n""",
)
def threshold_sweep(spark, sf):
    return rounded(M.threshold_sweep(_l(spark, sf), Y, S))


@query(
    "calibration_curve",
    f"""WITH {Q.LABELLED} SELECT {' + '.join(f'CAST(probability > {e!r} AS INTEGER)' for e in M.unit_edges(15)[1:-1])} AS bin,
    round(sum(CAST(round(probability * 1000000) AS BIGINT)) / count(*)) / 1000000 AS mean_score, round(avg(fraudulent), 6) AS observed FROM labelled GROUP BY 1""",
)
def calibration_curve(spark, sf):
    return rounded(M.calibration_curve(_l(spark, sf), Y, S, places=6))


@query(
    "score_histogram",
    f"""WITH {Q.LABELLED}, ends AS (SELECT fraudulent, min(probability) AS lo, max(probability) AS hi, count(*) AS total FROM labelled GROUP BY 1)
    SELECT fraudulent AS label, CAST(least(29, floor((probability - lo) / (hi - lo) * 30)) AS INTEGER) AS bin, count(*) AS n,
      round(count(*) / (any_value(total) * ((any_value(hi) - any_value(lo)) / 30)), 6) AS density
    FROM labelled JOIN ends USING (fraudulent) GROUP BY 1, 2""",
)
def score_histogram(spark, sf):
    return rounded(M.score_histogram(_l(spark, sf), Y, S))


@query(
    "metrics_summary",
    f"""WITH {Q.SPLIT_RUNS},{Q.cumulative('split_runs', Y, S, 'split')} SELECT {Q.metrics('0.5', 'split')} FROM cum GROUP BY split""",
)
def metrics_summary(spark, sf):
    return rounded(M.all_metrics(V.split_runs(spark, sf), Y, S, T, ["split"]))


# --- slices --------------------------------------------------------------------------

_SLICE_COLUMNS = C.CATEGORY_FIELDS
_SLICES = "(" + " UNION ALL ".join(
    f"""SELECT '{c}' AS slice, coalesce("{c}", 'nan') AS category, fraudulent, probability, doc_id FROM labelled""" for c in _SLICE_COLUMNS
) + ")"


def _slice_sql(name: str, label: str, min_count: int) -> str:
    source = _SLICES.replace("fraudulent,", f"{label} AS fraudulent,")
    cum = Q.cumulative(source, Y, S, "slice, category").replace("counts AS", f"counts_{name} AS").replace(
        "FROM counts", f"FROM counts_{name}").replace("cum AS", f"cum_{name} AS")
    return f"""{cum},
{name} AS (SELECT {Q.metrics('0.5', 'slice, category')} FROM cum_{name} GROUP BY slice, category HAVING sum(pos + neg) >= {min_count})"""


@query("slice_metrics", f"WITH {Q.LABELLED},{_slice_sql('s', 'fraudulent', C.SLICE_MIN_COUNT)} SELECT * FROM s")
def slice_metrics(spark, sf):
    return rounded(M.slice_metrics(_l(spark, sf), Y, S, T, _SLICE_COLUMNS))


@query(
    "weakest_slices",
    f"""WITH {Q.LABELLED},{_slice_sql('s', 'fraudulent', C.SLICE_MIN_COUNT)}
    SELECT slice, category, count, f1, precision, recall FROM s ORDER BY f1 NULLS LAST, slice, category LIMIT 6""",
)
def weakest_slices(spark, sf):
    table = rounded(M.slice_metrics(_l(spark, sf), Y, S, T, _SLICE_COLUMNS))
    return M.weakest_slices(table).select("slice", "category", "count", "f1", "precision", "recall")


_STATE_SLICES = ("model_version", "predicted_label")


def _state_sql(by: str, where: str = "true") -> str:
    marked = "(SELECT *, strftime(created_at, '%Y%m%d') AS day, CAST(text_hash < '4' AS INTEGER) AS y FROM predictions)"
    parts = [f"SELECT 'all' AS slice, 'all' AS category, day, y, probability FROM {marked} WHERE {where}"] + [
        f"SELECT '{c}', coalesce({c}, 'nan'), day, y, probability FROM {marked} WHERE {where}" for c in _STATE_SLICES
    ]
    return f"""WITH {Q.PREDICTIONS},{Q.cumulative('(' + ' UNION ALL '.join(parts) + ')', 'y', 'probability', by)}
    SELECT {Q.metrics('0.5', by)} FROM cum GROUP BY {by}"""


def _states(spark, sf):
    """States of the prediction log, written in two parts as two nights would."""
    df = V.predictions(spark, sf).withColumn("y", (F.col("text_hash") < "4").cast("int"))
    root = scratch_path(spark, "metric-states")
    early = F.col("created_at") < "2024-01-16"
    for part in (df.filter(early), df.filter(~early)):
        ST.write_states(ST.daily_states(part, "y", "probability", "created_at", _STATE_SLICES), root)
    return root


@query("metrics_of_states", _state_sql("slice, category", "day BETWEEN '20240104' AND '20240125'"))
def metrics_of_states(spark, sf):
    """Metrics of three weeks, overall and by slice, from daily states; other days are not read."""
    states = ST.read_states(spark, _states(spark, sf), "20240104", "20240125")
    return rounded(ST.metrics_of_states(states, T))


@query("daily_metrics", _state_sql("day, slice, category"))
def daily_metrics(spark, sf):
    """Metrics of every day and slice from the same states."""
    return rounded(ST.metrics_of_states(ST.read_states(spark, _states(spark, sf)), T, ["day", "slice", "category"]))


_FLIP = "CASE WHEN doc_id % 9 = 0 THEN 1 - fraudulent ELSE fraudulent END"


@query(
    "slice_delta",
    f"""WITH {Q.LABELLED},{_slice_sql('b', 'fraudulent', C.SLICE_MIN_COUNT)},{_slice_sql('f', _FLIP, C.SLICE_MIN_COUNT)}
    SELECT b.slice, b.category, """
    + ", ".join(
        f"b.{m} AS {m}_baseline, f.{m} AS {m}_feedback" for m in ("count", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")
    )
    + ", "
    + ", ".join(f"{Q.r6(f'(f.{m} - b.{m})')} AS {m}_delta" for m in ("f1", "precision", "recall"))
    + " FROM b JOIN f USING (slice, category)",
)
def slice_delta(spark, sf):
    """Labels of every ninth document turned over, slices before and after."""
    df = _l(spark, sf)
    after = df.withColumn(Y, F.expr(_FLIP))
    tables = [rounded(M.slice_metrics(d, Y, S, T, _SLICE_COLUMNS)) for d in (df, after)]
    return rounded(M.slice_delta(*tables))


@query(
    "metric_deltas",
    f"""WITH {Q.SPLIT_RUNS},
    both_ AS (SELECT split, 'baseline' AS kind, fraudulent AS y, probability FROM split_runs
      UNION ALL SELECT split, 'with_feedback', {_FLIP}, probability FROM split_runs),
    {Q.cumulative('both_', 'y', S, 'split, kind')},
    m AS (SELECT {Q.metrics('0.5', 'split, kind')} FROM cum GROUP BY split, kind),
    l AS (UNPIVOT (SELECT split, kind, f1, precision, recall, roc_auc, pr_auc, brier FROM m)
      ON f1, precision, recall, roc_auc, pr_auc, brier INTO NAME metric VALUE value)
    SELECT split, metric, max(value) FILTER (WHERE kind = 'baseline') AS baseline,
      max(value) FILTER (WHERE kind = 'with_feedback') AS with_feedback,
      {Q.r6("(max(value) FILTER (WHERE kind = 'with_feedback') - max(value) FILTER (WHERE kind = 'baseline'))")} AS delta
    FROM l GROUP BY split, metric""",
)
def metric_deltas(spark, sf):
    df = V.split_runs(spark, sf).withColumn("reviewed", F.expr(_FLIP))
    out = rounded(M.metric_deltas(df, Y, "reviewed", S, T))
    return rounded(out.withColumn("delta", F.col("with_feedback") - F.col("baseline")))


@query(
    "slice_alerts",
    f"""WITH {Q.LABELLED},{_slice_sql('s', 'fraudulent', C.SLICE_MIN_COUNT)},
    o AS (SELECT {Q.r6(Q.ratio('2 * tp', '2 * tp + fp + fn'))} AS overall_f1 FROM (SELECT
      count(*) FILTER (WHERE fraudulent = 1 AND probability >= 0.5) AS tp, count(*) FILTER (WHERE fraudulent = 0 AND probability >= 0.5) AS fp,
      count(*) FILTER (WHERE fraudulent = 1 AND probability < 0.5) AS fn FROM labelled))
    SELECT slice, category, count, f1, overall_f1 FROM s, o WHERE f1 < overall_f1 - 0.1""",
)
def slice_alerts(spark, sf):
    return rounded(MO.slice_alerts(_l(spark, sf), Y, S, T, _SLICE_COLUMNS))


# --- regressions, drift, comparison -----------------------------------------------------


@query(
    "probability_regression",
    f"""WITH {Q.LABELLED}, m AS (SELECT regr_slope(probability, text_length) AS slope, regr_intercept(probability, text_length) AS intercept,
      corr(probability, text_length) AS r, regr_sxx(probability, text_length) AS sxx, regr_syy(probability, text_length) AS syy, count(*) AS n FROM labelled)
    , angle AS (SELECT *, n - 2 AS free, atan2(abs(r), sqrt(1 - r * r)) AS top FROM m),
    -- Student's density integrated by Simpson's rule, as powers of a cosine
    inside AS (SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(top * i / 4000), free - 1)) * any_value(top) / 12000 AS area
      FROM angle, range(4001) AS steps(i))
    SELECT round(slope, 9) AS slope, {Q.r6('intercept')} AS intercept, {Q.r6('r')} AS rvalue,
      {Q.r6('1 - 2 * area * exp(lgamma((free + 1) / 2.0) - lgamma(free / 2.0)) / sqrt(pi())')} AS pvalue,
      round(sqrt((1 - r * r) * syy / sxx / (n - 2)), 9) AS stderr, n FROM angle, inside""",
)
def probability_regression(spark, sf):
    m = M.probability_regression(_l(spark, sf), "text_length", S)
    return m.withColumns(
        {"slope": F.round("slope", 9), "stderr": F.round("stderr", 9), "intercept": F.round("intercept", 6), "rvalue": F.round("rvalue", 6), "pvalue": F.round("pvalue", 6)}
    )


_KS_PARTS = "created_at < TIMESTAMP '2024-01-16 00:00:00'"


@query(
    "ks_drift",
    f"""WITH {Q.PREDICTIONS}, c AS (SELECT probability AS s, count(*) FILTER (WHERE NOT ({_KS_PARTS})) AS a, count(*) FILTER (WHERE {_KS_PARTS}) AS b
      FROM predictions GROUP BY 1),
    r AS (SELECT CAST(sum(a) OVER (ORDER BY s) AS DOUBLE) / sum(a) OVER () AS fa, CAST(sum(b) OVER (ORDER BY s) AS DOUBLE) / sum(b) OVER () AS fb FROM c)
    SELECT round(max(abs(fa - fb)), 6) AS statistic, (SELECT CAST(sum(a) AS BIGINT) FROM c) AS n_recent, (SELECT CAST(sum(b) AS BIGINT) FROM c) AS n_baseline FROM r""",
)
def ks_drift(spark, sf):
    p = V.predictions(spark, sf)
    early = F.expr(_KS_PARTS)
    return rounded(MO.ks_drift(p.filter(~early), p.filter(early), "probability"))


def _side(score: str, threshold: float) -> str:
    tp, fp, fn = (
        f"count(*) FILTER (WHERE fraudulent = {y} AND {score} {op} {threshold})" for y, op in ((1, ">="), (0, ">="), (1, "<"))
    )
    return Q.ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")


@query(
    "shadow_compare",
    f"""WITH {Q.SPLIT_RUNS}, f AS (SELECT {_side('probability', 0.5)} AS a, {_side('shadow', 0.45)} AS b FROM split_runs),
    e AS (SELECT (SELECT ece FROM ({_ece('split_runs', Y, 'probability')})) AS ea, (SELECT ece FROM ({_ece('split_runs', Y, 'shadow')})) AS eb)
    SELECT round(a, 6) AS current_f1, round(b, 6) AS shadow_f1, round(ea, 6) AS current_ece, round(eb, 6) AS shadow_ece,
      {Q.r6('(b - a)')} AS f1_gain, (b - a >= 0.02 AND eb <= ea) AS promote FROM f, e""",
)
def shadow_compare(spark, sf):
    return rounded(MO.shadow_compare(V.split_runs(spark, sf), Y, (S, 0.5), ("shadow", 0.45)))


# --- decisions ---------------------------------------------------------------------------

_GRAY = "CASE WHEN {p} >= {u!r} THEN 'fraud' WHEN {p} <= {l!r} THEN 'legit' ELSE 'review' END"


def _gray(p: str, threshold: float, width: float) -> str:
    lower, upper = D.band(threshold, width)
    return _GRAY.format(p=p, u=upper, l=lower)


@query(
    "gray_zone",
    f"""WITH {Q.PREDICTIONS} SELECT request_id, {_gray('probability', 0.5, 0.1)} AS decision,
      {_gray('probability', 0.6, 0.2)} AS wide, {_gray('probability', 0.98, 0.1)} AS clipped FROM predictions""",
)
def gray_zone(spark, sf):
    return V.predictions(spark, sf).select(
        "request_id", D.gray_zone("probability", 0.5).alias("decision"),
        D.gray_zone("probability", 0.6, 0.2).alias("wide"), D.gray_zone("probability", 0.98, 0.1).alias("clipped"),
    )


@query(
    "gray_band",
    f"""{_CUM}, b AS ({_BEST})
    SELECT round(threshold, 6) AS threshold, round(greatest(0.0, threshold - 0.1 / 2), 6) AS lower, round(least(1.0, threshold + 0.1 / 2), 6) AS upper FROM b""",
)
def gray_band(spark, sf):
    """Review band around the threshold tuned on the labelled documents."""
    t = M.best_threshold(_l(spark, sf), Y, S).first()["threshold"]
    band = D.band_struct(t)
    one = V.labels(spark, sf).agg(F.count("*"))
    return rounded(one.select(F.lit(t).alias("threshold"), band["lower"].alias("lower"), band["upper"].alias("upper")))


@query(
    "score_clipped",
    f"""SELECT event_id, CAST(c >= 0.5 AS INTEGER) AS binary_label, {_gray('c', 0.5, 0.1)} AS decision, c AS probability_fraud, CAST(0.5 AS DOUBLE) AS threshold
    FROM (SELECT event_id, greatest(least(round(value / 400 - 0.1, 6), 1 - 1e-6), 1e-6) AS c FROM events)""",
)
def score_clipped(spark, sf):
    """Scores beyond [0, 1] on both sides, clipped before deciding."""
    df = V.table(spark, sf, "events").select("event_id", F.round(F.col("value") / 400 - 0.1, 6).alias("p"))
    return D.decide(df, "p", 0.5, clip_scores=True).drop("p")


_RULE_TEXT = "lower(concat_ws(' ', title, description, requirements, company_profile))"
_RULE_SQL = f"""
rules AS (
  SELECT doc_id, title, description AS description,
    CASE WHEN doc_id % 3 = 0 THEN left(description, CAST(doc_id % 200 AS INTEGER)) ELSE '' END AS requirements,
    CASE WHEN doc_id % 4 > 0 THEN left(description, CAST(doc_id % 150 AS INTEGER)) ELSE '' END AS company_profile,
    CASE WHEN doc_id % 2 = 0 THEN title ELSE '' END AS benefits, CASE WHEN doc_id % 5 > 2 THEN 'x' END AS required_education,
    required_experience, industry FROM postings),
rule_score AS (
  SELECT doc_id, greatest(least(0.5 + (
    CAST(contains(t, 'earn') AND contains(t, 'from home') AS INTEGER) + CAST(contains(t, 'no experience') AS INTEGER)
    + CAST(contains(t, 'urgent') OR contains(t, 'immediate') AS INTEGER) + CAST(contains(t, '$$$') OR contains(t, 'money') AS INTEGER)
    + CAST(length(company_profile) < 20 AS INTEGER) + CAST(length(requirements) < 30 AS INTEGER)) * 0.15::DOUBLE
    - (CAST(length(company_profile) > 100 AS INTEGER) + CAST(length(requirements) > 100 AS INTEGER) + CAST(length(benefits) > 50 AS INTEGER)
    + CAST(coalesce(required_education, '') <> '' AS INTEGER) + CAST(coalesce(required_experience, '') <> '' AS INTEGER)
    + CAST(coalesce(industry, '') <> '' AS INTEGER)) * 0.1::DOUBLE, 0.9::DOUBLE), 0.1::DOUBLE) AS p
  FROM (SELECT *, lower(concat_ws(' ', title, description, requirements, company_profile)) AS t FROM rules))"""


@query(
    "rule_score",
    f"""WITH {Q.POSTINGS},{_RULE_SQL}
    SELECT doc_id, round(p, 6) AS rule_probability, CASE WHEN round(p, 6) < 0.4 THEN 'legit' WHEN round(p, 6) > 0.6 THEN 'fraud' ELSE 'review' END AS rule_decision
    FROM rule_score""",
)
def rule_score(spark, sf):
    i, text = F.col("doc_id"), F.col("description")
    df = V.postings(spark, sf).select(
        "doc_id", "title", "description",
        F.when(i % 3 == 0, F.left(text, i % 200)).otherwise("").alias("requirements"),
        F.when(i % 4 > 0, F.left(text, i % 150)).otherwise("").alias("company_profile"),
        F.when(i % 2 == 0, F.col("title")).otherwise("").alias("benefits"),
        F.when(i % 5 > 2, "x").alias("required_education"), "required_experience", "industry",
    )
    return rounded(D.rule_score(df).select("doc_id", "rule_probability", "rule_decision"))


# --- calibration and ensembles on given columns --------------------------------------------


@query(
    "apply_platt",
    f"""WITH {Q.SCORED} SELECT doc_id, {Q.r6('1.0 / (1.0 + exp(-(1.7 * s - 0.4)))')} AS platt, probability AS unknown
    FROM (SELECT doc_id, probability, ln(p / (1 - p)) AS s FROM (SELECT *, greatest(least(probability, 1 - 1e-6), 1e-6) AS p FROM scored))""",
)
def apply_platt(spark, sf):
    df = V.scored(spark, sf).withColumn("s", N.logit(S))
    params = {"coef": 1.7, "intercept": -0.4}
    return rounded(df.select(
        "doc_id", N.apply_calibration("platt", S, "s", params).alias("platt"),
        N.apply_calibration("other", S, "s", params).alias("unknown"),
    ))


@query(
    "ensemble_mean",
    f"""WITH {Q.SPLIT_RUNS} SELECT doc_id, round(0.0 + 0.5 * probability + 0.5 * shadow, 9) AS plain, round(0.0 + 0.75 * probability + 0.25 * shadow, 9) AS weighted FROM split_runs""",
)
def ensemble_mean(spark, sf):
    return V.split_runs(spark, sf).select(
        "doc_id", F.round(N.weighted_mean([S, "shadow"]), 9).alias("plain"),
        F.round(N.weighted_mean([S, "shadow"], [3, 1]), 9).alias("weighted"),
    )


@query(
    "choose_calibrator",
    f"""WITH {Q.SPLIT_RUNS},
    l AS (SELECT 'raw' AS method, fraudulent, probability AS s FROM split_runs UNION ALL SELECT 'shadow', fraudulent, shadow FROM split_runs
      UNION ALL SELECT 'half', fraudulent, probability / 2 FROM split_runs),
    e AS ({_ece('l', Y, 's', 'method')}),
    b AS (SELECT method, avg((s - fraudulent) * (s - fraudulent)) AS brier FROM l GROUP BY method)
    SELECT method, round(brier, 6) AS brier, round(ece, 6) AS ece FROM b JOIN e USING (method) ORDER BY b.brier, e.ece, method LIMIT 1""",
)
def choose_calibrator(spark, sf):
    df = V.split_runs(spark, sf).withColumn("half", F.col(S) / 2)
    return rounded(K.choose_calibrator(df, Y, {"raw": S, "shadow": "shadow", "half": "half"}))


_MIXES = [tuple([1.0 / 3] * 3), *MD.weight_grid(3)]


@query(
    "ensemble_weights",
    f"""WITH {Q.SPLIT_RUNS}, g(mix, w1, w2, w3) AS (VALUES {', '.join(f'({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)' for i, (a, b, c) in enumerate(_MIXES))}),
    l AS (SELECT mix, fraudulent, 0.0::DOUBLE + probability * w1 + shadow * w2 + (text_length / 10000) * w3 AS score FROM split_runs, g),
    {Q.cumulative('l', Y, 'score', 'mix')},
    f AS (SELECT *, 2.0 * cum_pos / (all_pos + cum_pos + cum_neg) AS f1 FROM cum),
    b AS (SELECT mix, score, f1 FROM (SELECT *, row_number() OVER (PARTITION BY mix ORDER BY f1 DESC, score) AS r FROM f) WHERE r = 1)
    SELECT mix, w1, w2, w3, round(greatest(least(score, 1 - 1e-6), 1e-6), 6) AS threshold, round(f1, 6) AS f1,
      mix = (SELECT mix FROM b ORDER BY f1 DESC, mix LIMIT 1) AS is_best FROM b JOIN g USING (mix)""",
)
def ensemble_weights(spark, sf):
    df = V.split_runs(spark, sf).withColumn("length_share", F.col("text_length") / 10000)
    out = MD.ensemble_search(df, Y, [S, "shadow", "length_share"])
    return out.withColumns({"threshold": F.round("threshold", 6), "f1": F.round("f1", 6)})


@query(
    "select_best",
    f"""WITH {Q.SPLIT_RUNS}, l AS (SELECT 0 AS place, 'main' AS name, fraudulent, probability AS s FROM split_runs
      UNION ALL SELECT 1, 'shadow', fraudulent, shadow FROM split_runs UNION ALL SELECT 2, 'copy', fraudulent, probability FROM split_runs),
    {Q.cumulative('l', Y, 's', 'place, name')},
    f AS (SELECT *, 2.0 * cum_pos / (all_pos + cum_pos + cum_neg) AS f1 FROM cum)
    SELECT name, place, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, place LIMIT 1""",
)
def select_best(spark, sf):
    cells = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(c).alias("s"))
        for i, (n, c) in enumerate((("main", S), ("shadow", "shadow"), ("copy", S)))
    ])
    rows = V.split_runs(spark, sf).select(Y, F.explode(cells).alias("c")).select(Y, "c.*")
    table = M.best_threshold(rows, Y, "s", ["place", "name"]).select("name", "place", "f1")
    return rounded(MD.select_best(table, "place"))


@query(
    "class_weights",
    """SELECT pos, neg, round((pos + neg) / (2.0 * pos), 6) AS weight_pos, round((pos + neg) / (2.0 * neg), 6) AS weight_neg,
      greatest(neg // greatest(pos, 1), 1) AS scale_pos_weight
    FROM (SELECT count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic = 0) AS neg FROM labels)""",
)
def class_weights(spark, sf):
    return rounded(MD.class_weights(V.labels(spark, sf), Y))
