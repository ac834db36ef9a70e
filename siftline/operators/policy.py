"""Three-way decision and scoring output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions.scalars import clip
from siftline.functions.text import col_of


def band(threshold: float, width: float = C.GRAY_WIDTH) -> tuple[float, float]:
    """Bounds of the review band."""
    return max(0.0, threshold - width / 2), min(1.0, threshold + width / 2)


def band_struct(threshold: float, width: float = C.GRAY_WIDTH) -> Column:
    lower, upper = band(threshold, width)
    return F.struct(
        F.lit(width).alias("width"),
        F.lit(lower).alias("lower"),
        F.lit(upper).alias("upper"),
        F.lit(C.POSITIVE).alias("positive_label"),
        F.lit(C.NEGATIVE).alias("negative_label"),
        F.lit(C.REVIEW).alias("review_label"),
    )


def gray_zone(
    probability: str | Column,
    threshold: float,
    width: float = C.GRAY_WIDTH,
    positive: str = C.POSITIVE,
    negative: str = C.NEGATIVE,
    review: str = C.REVIEW,
) -> Column:
    """At or above the band: positive; at or below it: negative; inside: review."""
    p = col_of(probability)
    lower, upper = band(threshold, width)
    return F.when(p >= upper, positive).when(p <= lower, negative).otherwise(review)


def in_band(probability: str | Column, threshold: float, width: float = C.GRAY_WIDTH) -> Column:
    """Queue membership: both edges included, unlike `gray_zone`."""
    return col_of(probability).between(*band(threshold, width))


def decide(
    df: DataFrame,
    probability: str,
    threshold: float,
    width: float = C.GRAY_WIDTH,
    clip_scores: bool = False,
) -> DataFrame:
    """Add `probability_fraud`, `binary_label`, `decision`, `threshold`.

    The label and the decision are independent: a positive may still go to review.
    """
    p = F.col(probability)
    if clip_scores:
        p = clip(p, 1e-6, 1 - 1e-6)
    return df.withColumns(
        {
            "probability_fraud": p,
            "binary_label": (p >= threshold).cast("int"),
            "decision": gray_zone(p, threshold, width),
            "threshold": F.lit(float(threshold)),
        }
    )


def rule_score(df: DataFrame) -> DataFrame:
    """Twelve hand-written signals: `rule_probability` and `rule_decision`.

    Six raise the score by 0.15 each, six lower it by 0.1, around 0.5, kept within
    [0.1, 0.9]; the band is 0.4 to 0.6 and its edges go to review.
    """
    fields = ("title", "description", "requirements", "company_profile")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))

    def has(word):
        return F.contains(text, F.lit(word))

    def size(name):
        return F.length(F.coalesce(F.col(name), F.lit("")))

    def filled(name):
        return size(name) > 0

    raising = [
        has("earn") & has("from home"),
        has("no experience"),
        has("urgent") | has("immediate"),
        has("$$$") | has("money"),
        size("company_profile") < 20,
        size("requirements") < 30,
    ]
    lowering = [
        size("company_profile") > 100,
        size("requirements") > 100,
        size("benefits") > 50,
        filled("required_education"),
        filled("required_experience"),
        filled("industry"),
    ]
    up = sum((c.cast("int") for c in raising), F.lit(0))
    down = sum((c.cast("int") for c in lowering), F.lit(0))
    p = clip(F.lit(0.5) + up * 0.15 - down * 0.1, 0.1, 0.9)
    # rounded before comparing, so that 0.4 and 0.6 are the band edges exactly
    rounded = F.round(p, 6)
    decision = F.when(rounded < 0.4, C.NEGATIVE).when(rounded > 0.6, C.POSITIVE).otherwise(C.REVIEW)
    return df.withColumns({"rule_probability": p, "rule_decision": decision})
