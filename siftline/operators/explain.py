"""Why a record got its score."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline import constants as C
from siftline.functions import text as X
from siftline.functions.scalars import fixed
from siftline.operators.features import LinearModel, explode_terms, raw_weight, row_norm, term_counts, weighed_terms

CONTRIBUTION = "feature string, source string, contribution double"


def top_terms(terms: DataFrame, n: int = 25) -> DataFrame:
    """The n largest and n smallest coefficients: (sign, rank, term, weight).

    Two top-k scans of the coefficient table; the ranks order at most n rows each.
    """
    def side(sign, order):
        best = terms.orderBy(*order).limit(n).select("term", F.col("coef").alias("weight"))
        place = W.partitionBy(F.lit(sign)).orderBy(
            F.col("weight").desc() if sign == "positive" else F.col("weight").asc(), "term"
        )
        return best.select(
            F.lit(sign).alias("sign"), F.row_number().over(place).alias("rank"), "term", "weight"
        )

    return side("positive", [F.col("coef").desc(), "term"]).unionByName(
        side("negative", [F.col("coef").asc(), "term"])
    )


def contribution_rows(df: DataFrame, text: str, key: str, model: LinearModel) -> DataFrame:
    """(key, feature, source, contribution) for every non-zero value times coefficient.

    `df` holds the tabular features. Every record is explained where it is read: the terms of a
    small literal model are constants, those of others are probed by blocks. Only for models
    above `C.MAX_VOCABULARY` terms records move, once, by key.
    """
    parts = _tabular_parts(model)
    ready = df.withColumn("_parts", parts)
    counted = term_counts(ready, text, [key, "_parts"], only=model.only())
    if model.in_row():
        rows = counted.select(key, "_parts", model.row_weights("terms").alias("_weights"))
        rows = rows.select(key, "_parts", "_weights", F.sqrt(row_norm("_weights")).alias("_norm"))
        tokens = F.transform("_weights", lambda x: _part(x["term"], "token", x["w"] / F.col("_norm") * x["coef"]))
    elif model.bounded():
        rows = weighed_terms(counted, [key, "_parts"], model.terms, ["idf", "coef"])
        tokens = F.transform(
            "_weighed", lambda x: _part(x["term"], "token", x["w"] / F.col("_norm") * x["entry"]["coef"])
        )
    else:
        return _joined_contributions(df, text, key, model)
    long = rows.select(key, F.explode_outer(F.concat(tokens, "_parts")).alias("_p"))
    return long.select(key, "_p.*").filter(F.col("contribution") != 0.0)


def _part(feature: Column, source: str, value: Column) -> Column:
    return F.struct(feature.alias("feature"), F.lit(source).alias("source"), value.alias("contribution"))


def _tabular_parts(model: LinearModel) -> Column:
    parts = [
        _part(F.lit(n), "tabular", F.lit(coef) * ((F.col(n) - F.lit(mean)) / F.lit(scale)))
        for n, (mean, scale, coef) in model.tabular.items()
    ]
    return F.array(*parts) if parts else F.array().cast(f"array<struct<{CONTRIBUTION}>>")


def _joined_contributions(df: DataFrame, text: str, key: str, model: LinearModel) -> DataFrame:
    placed = df.repartition(key)
    long = explode_terms(term_counts(placed, text, [key], only=model.only()), [key])
    weighed = model.lookup(long).withColumn("_w", raw_weight())
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    tokens = weighed.select(
        key,
        F.col("term").alias("feature"),
        F.lit("token").alias("source"),
        (F.col("_w") / norm * F.col("coef")).alias("contribution"),
    )
    table = placed.select(key, F.explode(_tabular_parts(model)).alias("_p")).select(key, "_p.*")
    return tokens.unionByName(table).filter(F.col("contribution") != 0.0)


def mean_contributions(
    parts: Sequence[tuple[DataFrame, float]], key: str
) -> DataFrame:
    """Contributions of an ensemble: weighted mean over its linear components."""
    total = sum(w for _, w in parts)
    merged = None
    for rows, weight in parts:
        scaled = rows.withColumn("contribution", F.col("contribution") * (weight / total))
        merged = scaled if merged is None else merged.unionByName(scaled)
    return merged.groupBy(key, "feature", "source").agg(F.sum("contribution").alias("contribution"))


def top_contributions(rows: DataFrame, key: str, top_k: int = 5, digits: int = 9) -> DataFrame:
    """(key, sign, rank, feature, source, contribution): the strongest of each sign.

    `rank <= k` limits every task to its own best rows before the exchange. Ties, after
    rounding to `digits`, go by feature name.
    """
    size = F.round(F.abs("contribution"), digits)
    sign = F.when(F.col("contribution") > 0, "positive").otherwise("negative")
    place = W.partitionBy(key, "sign").orderBy(size.desc(), "feature", "source")
    return (
        rows.withColumn("sign", sign)
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= top_k)
        .select(key, "sign", "rank", "feature", "source", "contribution")
    )


def explanations(
    rows: DataFrame, key: str, intercept: float, top_k: int = 5, names: int = 3
) -> DataFrame:
    """(key, top_positive, top_negative, intercept, summary), one row per record in `rows`."""
    top = top_contributions(rows, key, max(top_k, names))
    item = F.struct("rank", "feature", "source", "contribution")
    wide = top.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("sign") == "positive", item))).alias("_p"),
        F.sort_array(F.collect_list(F.when(F.col("sign") == "negative", item))).alias("_n"),
    )

    def items(c):
        return F.transform(
            F.slice(c, 1, top_k),
            lambda s: F.struct(
                s["feature"].alias("feature"),
                s["source"].alias("source"),
                s["contribution"].alias("contribution"),
            ),
        )

    def leading(c):
        return F.transform(F.slice(c, 1, names), lambda s: X.humanize(s["feature"]))

    return wide.select(
        key,
        items("_p").alias("top_positive"),
        items("_n").alias("top_negative"),
        F.lit(intercept).alias("intercept"),
        X.driver_sentence(leading("_p"), leading("_n")).alias("summary"),
    )


def with_explanations(df: DataFrame, explained: DataFrame, key: str, linear: bool = True) -> DataFrame:
    """Attach explanations; records without drivers get the fixed sentence."""
    empty = F.from_json(F.lit("[]"), f"array<struct<{CONTRIBUTION}>>")
    sentence = C.NO_DRIVERS if linear else C.NOT_LINEAR
    return df.join(explained, key, "left").withColumns(
        {
            "top_positive": F.coalesce("top_positive", empty),
            "top_negative": F.coalesce("top_negative", empty),
            "summary": F.coalesce("summary", F.lit(sentence)),
        }
    )


def linear_shap(df: DataFrame, coefs: dict[str, float]) -> DataFrame:
    """(feature, mean_abs_shap) of a linear model: mean |coef (x - mean x)|, all rows.

    The means are one row, read as a scalar subquery; the spread is a second aggregation.
    """
    means = df.agg(F.struct(*[F.avg(n).alias(n) for n in coefs])).scalar()
    spread = df.agg(
        *[F.avg(F.abs(F.lit(float(c)) * (F.col(n) - means[n]))).alias(n) for n, c in coefs.items()]
    )
    return spread.unpivot([], list(coefs), "feature", "mean_abs_shap")


def linear_shap_terms(weights: DataFrame, documents: DataFrame) -> DataFrame:
    """The same over sparse terms: weights is (key, term, weight, coef).

    Documents without the term sit at -mean, so their share is added from the counts and
    the zeros are never materialised. Two passes of one aggregation each.
    """
    n = documents.agg(F.count("*")).scalar()
    totals = weights.groupBy("term").agg(
        F.sum("weight").alias("_sum"), F.count("*").alias("_df"), F.max("coef").alias("coef")
    )
    means = totals.select(
        "term", "coef", (F.col("_sum") / n).alias("_mean"), (n - F.col("_df")).alias("_zeros")
    )
    # one row per vocabulary term, bounded by its cap
    away = weights.select("term", "weight").join(F.broadcast(means), "term")
    return (
        away.groupBy("term", "coef", "_mean", "_zeros")
        .agg(F.sum(F.abs(F.col("weight") - F.col("_mean"))).alias("_away"))
        .select(
            F.col("term").alias("feature"),
            (F.abs("coef") * (F.col("_away") + F.col("_zeros") * F.abs("_mean")) / n).alias(
                "mean_abs_shap"
            ),
        )
    )


def token_frequency(
    df: DataFrame, text: str, score: str, threshold: float, top_k: int = 30
) -> DataFrame:
    """Tokens most frequent among predicted positives or negatives, with both counts."""
    tokens = df.select(
        (F.col(score) >= threshold).alias("_hit"), F.explode(X.split_tokens(text)).alias("token")
    )
    counts = tokens.groupBy("token").agg(
        F.count_if("_hit").alias("positive_count"), F.count_if(~F.col("_hit")).alias("negative_count")
    )

    def leading(c):
        return counts.filter(F.col(c) > 0).orderBy(F.col(c).desc(), "token").limit(top_k)

    both = leading("positive_count").union(leading("negative_count")).distinct()
    return both.withColumn("difference", F.col("positive_count") - F.col("negative_count"))


def local_surrogate(
    df: DataFrame,
    text: str,
    key: str,
    model: LinearModel,
    samples: int = 64,
    top_k: int = 8,
    seed: int = C.SPLIT_SEED,
) -> DataFrame:
    """(key, feature, weight): a weighted linear fit around each record.

    Terms of the model are removed at random, the record is scored again, and a ridge
    fit weighted by closeness tells what each term does locally. A record's terms are
    one array cell, so records are independent and the fit runs on Arrow batches without
    a further shuffle. `df` holds the tabular features.
    """
    placed = df.withColumn("_base", F.lit(model.intercept) + model.tabular_sum())
    long = explode_terms(
        term_counts(placed, text, [key, "_base"], only=model.only()), [key, "_base"]
    )
    cells = (
        model.lookup(long)
        .withColumn("_w", raw_weight())
        .groupBy(key, "_base")
        .agg(F.sort_array(F.collect_list(F.struct("term", "_w", "coef"))).alias("cells"))
    )
    kind = dict(df.dtypes)[key]

    def fit(batches):
        import zlib

        import numpy as np

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ident, base, parts = row
                w = np.array([p["_w"] for p in parts])
                coef = np.array([p["coef"] for p in parts])
                rng = np.random.default_rng([seed, zlib.crc32(str(ident).encode())])
                keep = rng.random((samples, len(w))) < 0.5
                keep[0] = True
                norm = np.sqrt((keep * w**2).sum(axis=1))
                dot = (keep * w * coef).sum(axis=1)
                part = np.divide(dot, norm, out=np.zeros(samples), where=norm > 0)
                score = 1 / (1 + np.exp(-(base + part)))
                removed = 1 - np.sqrt(keep.mean(axis=1))
                near = np.sqrt(np.exp(-((removed / 0.25) ** 2)))[:, None]
                design = np.column_stack([np.ones(samples), keep]) * near
                gram = design.T @ design + np.diag([0.0] + [1.0] * len(w))
                beta = np.linalg.solve(gram, design.T @ (score[:, None] * near))[1:, 0]
                order = np.argsort(-np.abs(beta), kind="stable")[:top_k]
                out += [(ident, parts[i]["term"], float(beta[i])) for i in order]
            yield pd.DataFrame(out, columns=[key, "feature", "weight"])

    return cells.mapInPandas(fit, f"{key} {kind}, feature string, weight double")


def merge_subwords(
    pieces: DataFrame, key: str, position: str, piece: str, score: str, special: Sequence[str] = ()
) -> DataFrame:
    """(key, word_no, feature, contribution): `##` pieces joined to the word they continue.

    Special, empty and blank pieces are skipped. One key is one record's piece list.
    """
    body = F.when(F.startswith(F.col(piece), F.lit("##")), F.substring(piece, 3, 2**31 - 1))
    clean = X.trim_ws(F.replace(F.coalesce(body, F.col(piece)), F.lit("▁"), F.lit(" ")))
    rows = pieces.withColumn("_c", clean).filter((F.col(piece) != "") & (F.col("_c") != ""))
    if special:
        rows = rows.filter(~F.col(piece).isin(*special))
    order = W.partitionBy(key).orderBy(position)
    starts = ~F.startswith(F.col(piece), F.lit("##")) | (F.row_number().over(order) == 1)
    rows = rows.withColumn("_start", starts.cast("int")).withColumn(
        "word_no", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    cells = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("_c").alias("c"))))
    return rows.groupBy(key, "word_no").agg(
        F.array_join(F.transform(cells, lambda s: s["c"]), "").alias("feature"),
        F.sum(score).alias("contribution"),
    )


def _lines(items: Column, n: int) -> Column:
    return F.array_join(
        F.transform(
            F.slice(items, 1, n),
            lambda s: F.concat(F.lit("  - "), s["feature"], F.lit(": "), fixed(s["contribution"], 3)),
        ),
        "\n",
    )


def detection_block(
    probability: str | Column,
    decision: str | Column,
    binary_label: str | Column,
    positive: Column | None = None,
    negative: Column | None = None,
) -> Column:
    """Context lines of a record scored on the fly, with what the reader is to explain."""
    fraud = F.concat(F.lit("Fraud Probability: "), fixed(X.col_of(probability) * 100, 1), F.lit("%"))
    label = F.when(X.col_of(binary_label) == 1, "FRAUDULENT").otherwise("LEGITIMATE")
    parts = [
        F.lit("=== FRAUD DETECTION ANALYSIS ==="),
        fraud,
        F.concat(F.lit("Decision: "), X.col_of(decision)),
        F.concat(F.lit("Classification: "), label),
    ]
    for items, title in ((positive, "Top Fraud Indicators"), (negative, "Top Legitimacy Signals")):
        if items is not None:
            block = F.concat(F.lit(f"\n{title}:\n"), _lines(items, 5))
            parts.append(F.when(F.size(items) > 0, block))
    parts.append(
        F.lit(
            "\nBased on this analysis, provide a detailed but concise explanation of:\n"
            "1. Whether this job posting appears fraudulent and why\n"
            "2. The main red flags or positive signals\n"
            "3. Actionable advice for the job seeker"
        )
    )
    return F.concat_ws("\n", *parts)


def result_block(
    probability: str | Column,
    decision: str | Column,
    binary_label: str | Column,
    positive: Column | None = None,
    negative: Column | None = None,
) -> Column:
    """Context lines of a record whose result is already known."""
    label = F.when(X.col_of(binary_label) == 1, "Fraudulent").otherwise("Legitimate")
    parts = [
        F.lit("Fraud Detection Result:"),
        F.concat(F.lit("- Fraud Probability: "), fixed(X.col_of(probability) * 100, 1), F.lit("%")),
        F.concat(F.lit("- Decision: "), X.col_of(decision)),
        F.concat(F.lit("- Binary Label: "), label),
    ]
    sides = ((positive, "Top Fraud Indicators"), (negative, "Top Legitimacy Indicators"))
    for items, title in sides:
        if items is not None:
            block = F.concat(F.lit(f"\n{title}:\n"), _lines(items, 3))
            parts.append(F.when(F.size(items) > 0, block))
    return F.concat_ws("\n", *parts)


def posting_block(columns: Sequence[str]) -> Column:
    """Context lines of a posting: long fields as prefixes, blank fields left out."""
    shown = (
        ("title", "Title", None),
        ("company_profile", "Company", 200),
        ("description", "Description", 300),
        ("location", "Location", None),
        ("employment_type", "Employment Type", None),
    )
    parts = [F.lit("\nJob Posting Details:")]
    for name, title, chars in shown:
        if name in columns:
            value = F.col(name)
            body = value if chars is None else F.concat(F.substring(value, 1, chars), F.lit("..."))
            line = F.concat(F.lit(f"- {title}: "), body)
            parts.append(F.when(F.length(value) > 0, line))
    return F.concat_ws("\n", *parts)


def heuristic_block() -> Column:
    return F.lit(
        "=== MESSAGE CLASSIFICATION ===\n"
        "Heuristic Assessment: Potential job posting based on keywords."
    )


def verdict_block(verdict: Column) -> Column:
    """Context lines of a parsed classifier verdict (see `scalars.extract_verdict`)."""
    kind = F.when(verdict["is_job_posting"], "Job Posting").otherwise("General Inquiry")
    sure = F.concat(F.lit(" ("), fixed(verdict["confidence"] * 100, 1), F.lit("% confidence)"))
    reason = X.trim_ws(verdict["reason"])
    return F.concat_ws(
        "\n",
        F.lit("=== MESSAGE CLASSIFICATION ==="),
        F.concat(F.lit("LLM Assessment: "), kind, F.coalesce(sure, F.lit(""))),
        F.when(reason != "", F.concat(F.lit("Rationale: "), reason)),
    )


def chat_message(message: str | Column, *blocks: Column) -> Column:
    """The user's message, preceded by the context where there is any."""
    context = X.trim_ws(F.concat_ws("\n", *blocks))
    return F.when(context == "", X.col_of(message)).otherwise(
        F.concat(
            F.lit("Context from the fraud detection pipeline:\n"),
            context,
            F.lit("\n\nOriginal user message:\n"),
            X.col_of(message),
        )
    )
