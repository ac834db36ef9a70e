"""Canonical views over the plain tables `documents labels pages conversations events
orders lineitem`: postings, scores, prediction and feedback logs, runs, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions.text import clean_text, concat_fields
from siftline.operators.features import LinearModel, linear_score, linear_scores, literal_model, tabular_features

# Coefficient tables of the two demonstration models: (term, idf, coef).
MODEL_TERMS = [
    ("idiot", 3.0, 5.0), ("trash", 3.0, 4.5), ("scum", 3.1, 5.0), ("clown", 3.0, 4.0),
    ("worthless", 3.1, 4.5), ("the", 1.2, -1.5), ("of", 1.3, -0.8), ("and", 1.3, -0.5),
    ("is", 1.4, 0.6), ("this", 1.6, 0.9), ("that", 1.5, 0.2), ("was", 1.5, 0.3),
    ("que", 2.2, -0.7), ("de", 2.1, -0.4), ("of the", 2.0, -0.6), ("in the", 2.1, 0.4),
]
SHADOW_TERMS = [
    ("idiot", 3.0, 4.0), ("trash", 3.0, 5.5), ("scum", 3.1, 4.0), ("clown", 3.0, 5.0),
    ("worthless", 3.1, 3.5), ("the", 1.2, -1.0), ("and", 1.3, 0.5), ("to", 1.3, -0.9),
    ("is", 1.4, 0.9), ("in the", 2.1, -0.4),
]
# Feature to (mean, scale, coef).
MODEL_TABULAR = {
    "text_length": (2400.0, 1800.0, 0.3),
    "digit_count": (20.0, 40.0, -0.2),
    "exclamation_count": (2.0, 5.0, 0.25),
    "question_count": (2.0, 5.0, 0.1),
}
MODEL_INTERCEPT, SHADOW_INTERCEPT = -0.6, -0.4
THRESHOLD = 0.5

# Phrases that the documents do hold, next to the default ones.
VIEW_PHRASES = (*C.SCAM_TERMS, "the", "idiot", "of the", "tion")


# Tables whose rows cost much CPU each.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan alone has fewer splits than there are cores.

    A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as postings; flags and categories carry the values the rules must meet."""
    docs = table(spark, folder, "documents")
    i = F.col("doc_id")
    return docs.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        "lang",
        "source",
        F.when(i % 5 == 0, C.MISSING).when(i % 7 == 0, "x").otherwise((i % 2).cast("string")).alias("telecommuting"),
        (i % 2).cast("int").alias("has_company_logo"),
        F.contains("text", F.lit("?")).cast("int").alias("has_questions"),
        F.col("lang").alias("employment_type"),
        F.when(i % 3 == 1, C.MISSING).when(i % 3 == 2, "Not Mentioned").alias("required_experience"),
        F.when(i % 4 == 1, C.MISSING).when(i % 4 == 2, "degree").alias("required_education"),
        F.col("source").alias("industry"),
        F.concat(F.lit("f"), (i % 4).cast("string")).alias("function"),
    )


def cleaned(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """Postings with cleaned title and description and `text_all`."""
    df = postings(spark, folder) if base is None else base
    df = df.withColumns({c: clean_text(c) for c in ("title", "description")})
    return df.withColumn("text_all", concat_fields(["title", "description"]))


def model(spark: SparkSession) -> LinearModel:
    return literal_model(spark, MODEL_TERMS, MODEL_INTERCEPT, MODEL_TABULAR)


def shadow_model(spark: SparkSession) -> LinearModel:
    return literal_model(spark, SHADOW_TERMS, SHADOW_INTERCEPT, MODEL_TABULAR)


def featured(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    return tabular_features(cleaned(spark, folder, base))


SCORED_COLUMNS = ("lang", "source", *C.CATEGORY_FIELDS, "text_length")


def _scored(df: DataFrame, which: LinearModel, keep: tuple[str, ...]) -> DataFrame:
    df = linear_score(df, "text_all", "doc_id", which, keep)
    return df.select("doc_id", *keep, F.round("probability", 6).alias("probability"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, categories, text_length, probability rounded to 6 places)."""
    return _scored(featured(spark, folder), model(spark), SCORED_COLUMNS)


def scored_text(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text_all, probability): texts scored where they are read."""
    return _scored(featured(spark, folder), model(spark), ("text_all",))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        "doc_id", F.col("toxic").alias("fraudulent"), "quality"
    )


def labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the documents that carry a label; the others drop out before any text work."""
    base = postings(spark, folder).join(labels(spark, folder), "doc_id")
    return featured(spark, folder, base)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Scored documents that carry a label."""
    keep = (*SCORED_COLUMNS, "fraudulent", "quality")
    return _scored(labelled_features(spark, folder), model(spark), keep)


def split_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents scored by two models, with a held-out flag by id."""
    keep = (*SCORED_COLUMNS, "fraudulent", "quality")
    models = {"probability": model(spark), "shadow": shadow_model(spark)}
    both = linear_scores(labelled_features(spark, folder), "text_all", "doc_id", models, keep)
    both = both.withColumns({n: F.round(n, 6) for n in models})
    return both.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "validation").otherwise("test"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the prediction log."""
    p = F.round(F.col("value") / (F.col("value") + 50), 6)
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("model_version"),
        p.alias("probability"),
        F.when(p >= 0.55, C.POSITIVE).when(p <= 0.45, C.NEGATIVE).otherwise(C.REVIEW).alias("predicted_label"),
        F.lit(0.5).alias("threshold"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("text_hash"),
        F.col("props").alias("payload"),
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as answered by a reviewer one hour later."""
    answer = F.element_at(F.array(*[F.lit(x) for x in C.REVIEWER_LABELS]), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        answer.alias("reviewer_label"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("text_hash"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
        F.concat(F.lit("mail u"), F.col("user_id"), F.lit("@x.org or 555-0"), F.lpad(F.col("event_id") % 1000, 3, "0"), F.lit("-12345")).alias("rationale"),
        F.col("props").alias("notes"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to every fifth event: the other events are pending."""
    return answers(spark, folder).filter(F.col("request_id").cast("long") % 5 == 0)


def active_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Every 97th event, and as many rows with ids nobody logged."""
    seen = predictions(spark, folder).filter(F.col("request_id").cast("long") % 97 == 0)
    seen = seen.drop("created_at")
    strange = seen.withColumn("request_id", F.concat(F.lit("-"), "request_id", F.lit("x")))
    return seen.unionByName(strange)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tracked runs."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("position"),
        F.col("o_orderpriority").alias("model_name"),
        F.col("o_orderstatus").alias("config_hash"),
        F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        (F.col("o_totalprice") / 1000000).alias("test_f1"),
        F.when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice") / 900000).alias("val_f1"),
        F.when(F.col("o_custkey") % 2 == 0, "platt").otherwise("isotonic").alias("calibration_method"),
        F.lit(0.5).alias("threshold"),
    )


def latency(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as latency measurements."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("batch_size"),
        F.col("l_extendedprice").alias("latency_ms"),
        F.col("l_quantity").alias("throughput_rps"),
    )
