"""Batch scoring: clean, features, score, decision, explanation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.operators.explain import contribution_rows, explanations, with_explanations
from siftline.operators.features import LinearModel, linear_score, tabular_features
from siftline.operators.ingest import preprocess
from siftline.operators.policy import band, decide


def score_batch(
    postings: DataFrame,
    key: str,
    model: LinearModel,
    threshold: float,
    width: float = C.GRAY_WIDTH,
    *,
    text_fields: Sequence[str] = C.TEXT_FIELDS,
    explain: bool = True,
    clip_scores: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per posting: probability, label, decision, band and explanation.

    Scores need one exchange of narrow rows; explanations one more, of the records by
    key. Only key-sized rows meet in the final join.
    """
    ready = tabular_features(preprocess(postings, text_fields=text_fields, drop=()))
    scores = linear_score(ready, "text_all", key, model, keep)
    lower, upper = band(threshold, width)
    out = decide(scores, "probability", threshold, width, clip_scores).withColumns(
        {"lower": F.lit(lower), "upper": F.lit(upper)}
    )
    out = out.drop("margin", "probability")
    if not explain:
        return out
    rows = contribution_rows(ready, "text_all", key, model)
    explained = explanations(rows, key, model.intercept).drop("intercept")
    out = out.withColumn("intercept", F.lit(float(model.intercept)))
    return with_explanations(out, explained, key)
