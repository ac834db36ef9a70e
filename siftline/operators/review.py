"""Prediction and feedback records, the review queue, reviewer labels, run tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siftline import constants as C
from siftline.functions import text as X
from siftline.functions.scalars import (
    coerce_time,
    lenient_double,
    queue_entropy,
    sample_entropy,
    sorted_json,
)
from siftline.operators.policy import band
from siftline.session import shuffle_width

PREDICTION_SCHEMA = (
    "request_id string, created_at timestamp, model_version string, probability double, "
    "predicted_label string, threshold double, text_hash string, features_hash string, "
    "payload string, explanation string, meta string"
)
FEEDBACK_SCHEMA = (
    "request_id string, model_version string, proba double, predicted_label string, "
    "reviewer_label string, text_hash string, features_hash string, rationale string, "
    "notes string, created_at timestamp"
)


# --- records ---------------------------------------------------------------------


def payload_json(columns: Mapping[str, str]) -> Column:
    """Masked and shortened payload as sorted JSON; columns maps a name to its type."""
    return sorted_json(
        {n: X.sanitize(n) if kind == "string" else F.col(n) for n, kind in columns.items()}
    )


def log_records(
    scored: DataFrame,
    *,
    key: str,
    batch_id: str | Column,
    as_of: str | Column,
    model_name: str,
    model_type: str,
    payload: Column,
    text_hash: Column,
    features_hash: Column,
    explanation: Column | None = None,
) -> DataFrame:
    """Rows of the prediction log from scored rows (see `policy.decide`).

    Payload (see `payload_json`) and hashes are taken from the raw columns before scoring
    and carried along. The request id is a digest of batch and row, so a retried task
    writes the same id.
    """
    batch = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    time = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    digest = F.sha2(F.concat_ws("|", batch, F.col(key).cast("string")), 256)
    meta = sorted_json({"model_name": F.lit(model_name), "model_type": F.lit(model_type)})
    return scored.select(
        digest.alias("request_id"),
        time.alias("created_at"),
        F.lit(model_name).alias("model_version"),
        F.col("probability_fraud").alias("probability"),
        F.col("decision").alias("predicted_label"),
        F.col("threshold").cast("double").alias("threshold"),
        text_hash.alias("text_hash"),
        features_hash.alias("features_hash"),
        payload.alias("payload"),
        (F.lit(None).cast("string") if explanation is None else explanation).alias("explanation"),
        meta.alias("meta"),
    )


def feedback_records(feedback: DataFrame, as_of: str | Column) -> DataFrame:
    """Feedback rows with a time and masked free text; unknown labels are an error."""
    out = feedback
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.lit(None).cast("timestamp"))
    masks = {c: X.mask_pii(c) for c in ("rationale", "notes") if c in out.columns}
    known = F.col("reviewer_label").isin(*C.REVIEWER_LABELS)
    checked = F.when(known, F.col("reviewer_label")).otherwise(
        F.raise_error(F.concat(F.lit("unknown reviewer label: "), F.col("reviewer_label")))
    )
    return out.withColumns(
        {**masks, "reviewer_label": checked, "created_at": coerce_time("created_at", as_of)}
    )


# --- admission -------------------------------------------------------------------


def known_ids(predictions: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Distinct request ids a reviewer may answer."""
    ids = predictions.select(F.col("request_id").cast("string"))
    if active is not None:
        ids = ids.unionByName(active.select(F.col("request_id").cast("string")))
    return ids.filter(F.col("request_id").isNotNull()).distinct()


def unknown_ids(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch whose request id was never logged."""
    return batch.join(known, "request_id", "left_anti")


def recognised_ids(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch whose request id was logged."""
    return batch.join(known, "request_id", "left_semi")


def admit_feedback(
    batch: DataFrame, known: DataFrame, max_rows: int = C.MAX_FEEDBACK_BATCH
) -> DataFrame:
    """The batch, or an error: empty, too large, or any id unknown while some are known.

    The checks read at most `max_rows + 1` rows of the batch.
    """
    ids = [r[0] for r in batch.select("request_id").limit(max_rows + 1).collect()]
    if not ids:
        raise ValueError("empty feedback payload")
    if len(ids) > max_rows:
        raise ValueError(f"feedback batch exceeds the limit of {max_rows}")
    bad = unknown_ids(batch.select("request_id"), known).limit(1).collect()
    if bad and not known.isEmpty():
        raise LookupError(f"unknown request_id {bad[0][0]}")
    return batch


def admit_batches(
    feedback: DataFrame, known: DataFrame, batch: str, max_rows: int = C.MAX_FEEDBACK_BATCH
) -> DataFrame:
    """Rows of many batches with an `outcome`: a batch is accepted or rejected as a whole.

    One unknown id rejects its batch where any id is known at all, as does a batch of more than
    `max_rows`. A null batch is a batch. Ids are looked up in one join, and each batch is then
    told its counts, so no batch is gathered.
    """
    flagged = feedback.join(known.select("request_id", F.lit(True).alias("_known")), "request_id", "left")
    told = flagged.groupBy(F.col(batch).alias("_batch")).agg(
        F.count("*").alias("_rows"), F.count_if(F.col("_known").isNull()).alias("_strange")
    )
    any_known = known.select(F.lit(1)).limit(1).agg(F.count("*")).scalar() > 0
    bad = (F.col("_rows") > max_rows) | ((F.col("_strange") > 0) & any_known)
    rows = flagged.join(told, F.col(batch).eqNullSafe(F.col("_batch")))
    return rows.select(*feedback.columns, F.when(bad, "rejected").otherwise("accepted").alias("outcome"))


# --- reviewer labels -------------------------------------------------------------


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """(text_hash, reviewer_label, created_at, request_id): newest decided answer per text.

    `max_by` combines on the map side, so a text answered very often stays cheap.
    """
    decided = feedback.filter(F.col("reviewer_label").isin(C.POSITIVE, C.NEGATIVE))
    row = F.struct("reviewer_label", "created_at", "request_id")
    newest = decided.groupBy("text_hash").agg(
        F.max_by(row, F.struct("created_at", "request_id")).alias("_row")
    )
    return newest.select("text_hash", "_row.*")


def skewed_lookup(
    rows: DataFrame, table: DataFrame, on: str, row_id: str | Column, hot_share: float = 0.001
) -> DataFrame:
    """Left join of `rows` to `table`, which has one row per key, safe for hot keys.

    Keys holding at least `hot_share` of the rows number at most 1 / hot_share, which
    bounds their broadcast. Their rows are spread over salts, and only their entries of
    `table` are repeated, so no task gets a whole hot key and the rest pays nothing. Rows
    without a key match nothing and are spread too.
    """
    salts = shuffle_width(rows.sparkSession)
    keyed = rows.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    total = keyed.agg(F.sum("_n")).scalar()
    hot = keyed.filter(F.col("_n") >= F.greatest(total * hot_share, F.lit(2))).select(
        on, F.lit(True).alias("_hot")
    )
    spread = F.pmod(F.xxhash64(X.col_of(row_id)), F.lit(salts)).cast("int")
    left = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(on).isNull(), spread).otherwise(0)
    )
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
    right = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies))
    return left.drop("_hot").join(right.drop("_hot"), [on, "_salt"], "left").drop("_salt")


def apply_feedback(
    rows: DataFrame, feedback: DataFrame, key: str, label: str = "fraudulent"
) -> DataFrame:
    """Reviewer labels over the originals, by text: `_original_label`, `_feedback_applied`."""
    newest = latest_feedback(feedback).select(
        "text_hash", (F.col("reviewer_label") == C.POSITIVE).cast("int").alias("_reviewed")
    )
    joined = skewed_lookup(rows, newest, "text_hash", key)
    return joined.withColumns(
        {
            "_original_label": F.col(label),
            "_feedback_applied": F.col("_reviewed").isNotNull(),
            label: F.coalesce("_reviewed", label),
        }
    ).drop("_reviewed")


def feedback_counts(df: DataFrame) -> DataFrame:
    """Overridden labels per split."""
    return df.groupBy("split").agg(F.count_if("_feedback_applied").alias("overrides"))


# --- queue -----------------------------------------------------------------------


def pending(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Predictions nobody has answered. Answered ids are made distinct first."""
    return predictions.join(feedback.select("request_id").distinct(), "request_id", "left_anti")


def union_first(frames: Sequence[DataFrame], key: str = "request_id") -> DataFrame:
    """Frames on top of each other, the first of equal keys kept; absent columns null."""
    merged = None
    for rank, df in enumerate(frames):
        tagged = df.withColumn("_rank", F.lit(rank))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    columns = [c for c in merged.columns if c not in ("_rank", key)]
    order = F.struct("_rank", *[c for c in ("created_at",) if c in columns])
    best = merged.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return best.select(key, "_row.*")


def review_queue(
    predictions: DataFrame,
    feedback: DataFrame,
    active: DataFrame | None = None,
    *,
    policy: str = "gray-zone",
    threshold: float = 0.5,
    width: float = C.GRAY_WIDTH,
    as_of: str | Column,
) -> DataFrame:
    """All cases awaiting review, with `entropy`, before ordering and paging.

    `gray-zone` keeps the band, both edges included; every policy adds the pending active
    sample whatever its score. When the band and the sample are both empty, all pending
    cases are offered instead.
    """
    waiting = pending(predictions, feedback)
    chosen = waiting
    sample = None if active is None else pending(active, feedback)
    if policy == "gray-zone":
        lower, upper = band(threshold, width)
        inside = F.col("probability").between(lower, upper)
        found = waiting.agg(F.count_if(inside)).scalar()
        if sample is not None:
            found = found + sample.agg(F.count("*")).scalar()
        chosen = waiting.filter(inside | (found == 0))
    if sample is not None:  # without any prediction there is nothing to review
        sample = sample.filter(predictions.select(F.lit(1)).limit(1).agg(F.count("*")).scalar() > 0)
    merged = union_first([chosen, *([] if sample is None else [sample])])
    for name in ("payload", "explanation"):
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast("string"))
    if "created_at" not in merged.columns:
        merged = merged.withColumn("created_at", F.lit(None).cast("timestamp"))
    return merged.withColumns(
        {
            "created_at": coerce_time("created_at", as_of),
            "payload": F.coalesce("payload", F.lit("{}")),
            "explanation": F.coalesce("explanation", F.lit("{}")),
            "entropy": queue_entropy("probability"),
        }
    )


def queue_order(order: str = "newest") -> list[Column]:
    """Sort keys of the queue."""
    keys = [F.col("created_at").desc(), F.col("request_id")]
    return [F.round("entropy", 9).desc(), *keys] if order == "uncertainty" else keys


def queue_page(
    queue: DataFrame, limit: int = 25, offset: int = 0, order: str = "newest"
) -> DataFrame:
    """One page with `total_pending`. The default order is newest first for every policy;
    `order="uncertainty"` keeps the entropy order instead."""
    total = queue.agg(F.count("*")).scalar()
    page = queue.orderBy(*queue_order(order))
    if offset:
        page = page.offset(offset)
    if limit:
        page = page.limit(limit)
    return page.withColumn("total_pending", total)


def write_queue_index(
    queue: DataFrame, root: str, order: str = "newest", rows_per_bucket: int = 100_000
) -> None:
    """The queue as a table cut into key ranges of its order, with the number of rows of each.

    `root/rows` has a folder for each range (`page_bucket`), `root/counts` one row with the order,
    the schema and the first place of every range: a number of entries that is bounded by
    the queue's rows over `rows_per_bucket`. Ranges come from a sample of the keys; where they are cut
    does not change a page. A queue that changes is written to a new root.
    """
    spark = queue.sparkSession
    held = queue.persist(StorageLevel.DISK_ONLY)
    try:
        buckets = max(1, -(-held.count() // rows_per_bucket))
        ranged = held.repartitionByRange(buckets, *queue_order(order))
        placed = ranged.withColumn("page_bucket", F.spark_partition_id())
        placed.write.mode("overwrite").partitionBy("page_bucket").parquet(f"{root}/rows")
    finally:
        held.unpersist()
    rows = spark.read.schema(placed.schema).parquet(f"{root}/rows")
    counts = {r["page_bucket"]: r["count"] for r in rows.groupBy("page_bucket").count().collect()}
    places, before = [], 0
    for bucket in sorted(counts):
        places.append((bucket, before, counts[bucket]))
        before += counts[bucket]
    table = [(order, placed.schema.json(), before, places)]
    schema = "page_order string, row_schema string, total long, places array<struct<bucket int, first long, n long>>"
    spark.createDataFrame(table, schema).write.mode("overwrite").parquet(f"{root}/counts")


def indexed_page(spark: SparkSession, root: str, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page of a queue written by `write_queue_index`, equal to `queue_page` at any offset.

    Only the ranges that hold the page are read and sorted: one, or two and more where the page
    crosses a cut. `total_pending` is known without a scan. An offset past the end gives
    no rows; `limit` 0 means the rest of the queue.
    """
    head = spark.read.parquet(f"{root}/counts").first()
    end = offset + limit if limit else head["total"]
    hit = [p for p in head["places"] if p["first"] < end and p["first"] + p["n"] > offset]
    rows = spark.read.schema(T.StructType.fromJson(json.loads(head["row_schema"]))).parquet(f"{root}/rows")
    page = rows.filter(F.col("page_bucket").isin([p["bucket"] for p in hit])).drop("page_bucket")
    page = page.orderBy(*queue_order(head["page_order"]))
    skipped = offset - hit[0]["first"] if hit else 0
    if skipped:
        page = page.offset(skipped)
    if limit:
        page = page.limit(limit)
    return page.withColumn("total_pending", F.lit(head["total"]).cast("long"))


def sample_uncertain(
    predictions: DataFrame, feedback: DataFrame, limit: int = 100, policy: str = "entropy"
) -> DataFrame:
    """The most uncertain unanswered predictions: highest entropy or smallest margin."""
    waiting = pending(predictions, feedback)
    if policy == "entropy":
        score = F.round(sample_entropy("probability"), 9).desc()
    elif policy == "margin":
        score = F.round(F.abs(F.col("probability") - 0.5), 9).asc()
    else:
        raise ValueError(f"unknown policy: {policy}")
    return waiting.orderBy(score, "request_id").limit(limit)


# --- runs and tables -------------------------------------------------------------


def latest_runs(runs: DataFrame, position: str, limit: int | None = 20) -> DataFrame:
    """Newest run per model and configuration, best test F1 first.

    Runs without a time lose to any with one; equal times keep the earlier row; blank
    names are skipped.
    """
    rows = runs.withColumns(
        {
            "model_name": X.trim_ws(F.coalesce("model_name", F.lit(""))),
            "config_hash": X.trim_ws(F.coalesce("config_hash", F.lit(""))),
            "timestamp": F.col("timestamp").cast("string").try_cast("timestamp"),
        }
    ).filter(F.col("model_name") != "")
    numbers = [c for c in ("threshold", *[n for n in C.RUN_COLUMNS if "_f1" in n or "_prec" in n or "_rec" in n]) if c in rows.columns]
    rows = rows.withColumns({c: lenient_double(c) for c in numbers})
    keys = ["model_name", "config_hash"]
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col("timestamp").isNotNull(), F.col("timestamp"), -F.col(position))
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    ranked = newest.select(*keys, "_row.*").orderBy(
        F.coalesce("test_f1", F.lit(0.0)).desc(), position
    )
    return ranked.limit(limit) if limit else ranked


def sort_table(
    table: DataFrame, column: str, direction: str, position: str, limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Sort by any column; null and NaN come last ascending and first descending.

    Equal values keep their position.
    """
    c = F.col(column)
    kind = table.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c, F.lit(None).cast("double"))
    key = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()
    out = table.orderBy(key, position)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def table_head(table: DataFrame, rank: str, limit: int, types: Mapping[str, str]) -> DataFrame:
    """First rows of a stored table by its rank column, cast to the declared types."""
    head = table.orderBy(F.col(rank).cast("long")).limit(limit)
    return head.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def last_turns(chat: DataFrame, turns: int = 10) -> DataFrame:
    """Last turns of every conversation, speakers named user and model.

    `rank <= turns` limits every task to its own last turns before the exchange, so a
    conversation of any length stays cheap.
    """
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = chat.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= turns)
    speaker = F.when(F.col("role") == "user", "user").otherwise("model")
    return kept.select("conv_id", "turn", speaker.alias("role"), F.col("text").alias("content"))
