"""Numeric, hash, JSON and time columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import col_of, trim_ws


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(x)))


def logit(x: str | Column, eps: float = 1e-6) -> Column:
    p = clip(col_of(x), eps, 1 - eps)
    return F.log(p / (1 - p))


def queue_entropy(p: str | Column) -> Column:
    """Binary entropy used to order the queue: 1e-9 inside the logarithms."""
    p = col_of(p)
    return -(p * F.log2(p + 1e-9) + (1 - p) * F.log2(1 - p + 1e-9))


def sample_entropy(p: str | Column) -> Column:
    """Binary entropy used by the sampler: probability clipped first."""
    p = clip(col_of(p), 1e-6, 1 - 1e-6)
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def softmax_last(logits: str | Column) -> Column:
    """Last component of the softmax of an array of logits."""
    z = col_of(logits)
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.exp(F.element_at(z, -1) - top) / total


def platt(score: str | Column, coef: float = 1.0, intercept: float = 0.0) -> Column:
    return sigmoid(F.lit(coef) * col_of(score) + F.lit(intercept))


def apply_calibration(
    method: str, probability: str | Column, score: str | Column, params: Mapping | None = None
) -> Column:
    """Platt parameters on the raw score; unknown methods leave the probability."""
    if method == "platt":
        p = params or {}
        return platt(score, float(p.get("coef", 1.0)), float(p.get("intercept", 0.0)))
    return col_of(probability)


def weighted_mean(columns: Sequence[str | Column], weights: Sequence[float] | None = None) -> Column:
    """Probability ensemble: weights normalised to one."""
    weights = [1.0] * len(columns) if weights is None else [float(w) for w in weights]
    if not columns:
        raise ValueError("an ensemble needs at least one score column")
    if len(weights) != len(columns):
        raise ValueError("one weight per score column is required")
    total = math.fsum(weights)
    if not math.isfinite(total) or total == 0.0:
        raise ValueError("ensemble weights must sum to a finite non-zero value")
    out = F.lit(0.0)
    for c, w in zip(columns, weights):
        out = out + F.lit(w / total) * col_of(c)
    return out


def lenient_double(x: str | Column) -> Column:
    """Number in the text, else null."""
    return trim_ws(col_of(x).cast("string")).try_cast("double")


def lenient_bool(x: str | Column) -> Column:
    return F.coalesce(
        F.lower(trim_ws(col_of(x).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False)
    )


def coerce_time(x: str | Column, as_of: str | Column) -> Column:
    """Timestamp in the text, else `as_of` (passed in, so that retries agree)."""
    fallback = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return F.coalesce(col_of(x).cast("string").try_cast("timestamp"), fallback)


def sorted_json(columns: Mapping[str, str | Column]) -> Column:
    """JSON object with sorted keys and explicit nulls."""
    fields = [col_of(columns[k]).alias(k) for k in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parse_json(x: str | Column, schema: T.StructType | str) -> Column:
    """Object in the text, an empty object where it is null or malformed."""
    return F.coalesce(F.from_json(col_of(x), schema), F.from_json(F.lit("{}"), schema))


def features_hash(columns: Mapping[str, str | Column]) -> Column:
    """SHA-256 of the feature values as sorted JSON; no features -> hash of ''."""
    if not columns:
        return F.sha2(F.lit(""), 256)
    return F.sha2(sorted_json({k: col_of(v).cast("double") for k, v in columns.items()}), 256)


def config_key(settings: str | Column) -> Column:
    """Identity of a configuration given as canonical JSON text."""
    return F.lpad(F.lower(F.hex(F.xxhash64(col_of(settings)))), 16, "0")


VERDICT_SCHEMA = "is_job_posting STRING, confidence STRING, reason STRING"


def extract_verdict(x: str | Column) -> Column:
    """Struct of a classifier's JSON answer: fenced block first, else outer braces.

    Null when no valid object is found. Flags and numbers are read leniently.
    """
    raw = trim_ws(x)
    fenced = F.get(
        F.filter(
            F.transform(F.split(raw, "```"), trim_ws),
            lambda s: F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")),
        ),
        0,
    )
    candidate = F.when(F.contains(raw, F.lit("```")), F.coalesce(fenced, raw)).otherwise(raw)
    braces = F.regexp_extract(candidate, r"(?s)\{.*\}", 0)
    candidate = F.when(
        F.startswith(candidate, F.lit("{")) | (braces == ""), candidate
    ).otherwise(braces)
    # a malformed object is null as a whole, not a struct of nulls
    valid = F.try_parse_json(candidate).isNotNull() & F.startswith(candidate, F.lit("{"))
    parsed = F.from_json(candidate, VERDICT_SCHEMA)
    return F.when(
        valid,
        F.struct(
            lenient_bool(parsed["is_job_posting"]).alias("is_job_posting"),
            lenient_double(parsed["confidence"]).alias("confidence"),
            parsed["reason"].alias("reason"),
        ),
    )


def fixed(x: str | Column, digits: int) -> Column:
    """Number as text with exactly `digits` decimals, halves away from zero.

    A decimal half such as 0.5115 is stored slightly off; the nudge keeps it a half.
    """
    c = col_of(x)
    nudged = c + F.signum(c) * F.lit(1e-12)
    return F.round(nudged, digits).cast(f"decimal(30,{digits})").cast("string")
