"""Logs, feedback, review queues, leaderboards, chat text and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions import scalars as N
from siftline.functions import text as X
from siftline.operators import explain as E
from siftline.operators import monitor as MO
from siftline.operators import policy as D
from siftline.operators import review as R
from siftline.operators.features import linear_score, tabular_features
from siftline.operators.split import hash_split
from siftline.plans import sql_parts as Q
from siftline.plans.catalog import query, rounded
from siftline.plans.scoring import score_batch as score_postings
from siftline.session import scratch_path
from siftline.sources import logs
from siftline.sources import views as V
from siftline.streaming.jobs import stream_admission as admit_by_state
from siftline.streaming.jobs import stream_feedback as admit_stream
from siftline.streaming.jobs import stream_score as score_stream

AS_OF = "2024-02-01 00:00:00"


# --- scoring output and logs -----------------------------------------------------------


@query(
    "score_batch",
    f"""WITH {Q.SCORED}
    SELECT doc_id, probability AS probability_fraud, CAST(probability >= 0.5 AS INTEGER) AS binary_label,
      CASE WHEN probability >= 0.55 THEN 'fraud' WHEN probability <= 0.45 THEN 'legit' ELSE 'review' END AS decision,
      CAST(0.5 AS DOUBLE) AS threshold, CAST(0.45 AS DOUBLE) AS lower, CAST(0.55 AS DOUBLE) AS upper FROM scored""",
)
def score_batch(spark, sf):
    """Raw postings in, decisions out; the flagship query."""
    df = V.postings(spark, sf).select("doc_id", "title", "description")
    out = score_postings(
        df, "doc_id", V.model(spark), V.THRESHOLD, text_fields=("title", "description"), explain=False
    )
    return rounded(out)


@query("score_batch_explained")
def score_batch_explained(spark, sf):
    df = V.postings(spark, sf).select("doc_id", "title", "description")
    return score_postings(
        df, "doc_id", V.model(spark), V.THRESHOLD, text_fields=("title", "description")
    )


def _log(spark, df, batch):
    """Scored postings as prediction-log rows."""
    payload = R.payload_json({"title": "string", "lang": "string", "has_company_logo": "int"})
    ready = df.withColumn("_payload", payload).withColumns(
        {c: X.clean_text(c) for c in ("title", "description")}
    )
    ready = ready.withColumn("text_all", X.concat_fields(["title", "description"]))
    hashes = {
        "_text": X.text_hash("text_all"),
        "_features": N.features_hash({n: n for n in V.MODEL_TABULAR}),
    }
    ready = tabular_features(ready).withColumns(hashes)
    keep = ["_payload", "_text", "_features", "created_at"]
    scored = linear_score(ready, "text_all", "doc_id", V.model(spark), keep)
    scored = scored.withColumn("probability", F.round("probability", 6))
    return R.log_records(
        D.decide(scored, "probability", V.THRESHOLD), key="doc_id", batch_id=batch, as_of=F.col("created_at"),
        model_name="view_model", model_type="classical", payload=F.col("_payload"),
        text_hash=F.col("_text"), features_hash=F.col("_features"),
    )


@query(
    "log_records",
    f"""WITH {Q.SCORED}
    SELECT sha256('batch-1|' || s.doc_id) AS request_id, TIMESTAMP '{AS_OF}' AS created_at, 'view_model' AS model_version, probability,
      {Q.shorten(Q.mask('p.title'))} AS payload_title,
      CASE WHEN probability >= 0.55 THEN 'fraud' WHEN probability <= 0.45 THEN 'legit' ELSE 'review' END AS predicted_label,
      CAST(0.5 AS DOUBLE) AS threshold, sha256(text_all) AS text_hash, p.has_company_logo AS payload_logo,
      '{{"model_name":"view_model","model_type":"classical"}}' AS meta
    FROM scored s JOIN clean c ON s.doc_id = c.doc_id JOIN postings p ON s.doc_id = p.doc_id""",
)
def log_records(spark, sf):
    """Log rows; the payload is read back from its JSON to be compared."""
    df = V.postings(spark, sf).withColumn("created_at", F.lit(AS_OF).cast("timestamp"))
    rows = _log(spark, df, "batch-1")
    payload = N.parse_json("payload", "title string, has_company_logo int")
    return rows.select(
        "request_id", "created_at", "model_version", "probability", payload["title"].alias("payload_title"),
        "predicted_label", "threshold", "text_hash", payload["has_company_logo"].alias("payload_logo"), "meta",
    )


@query(
    "feedback_records",
    f"""WITH {Q.ANSWERS}
    SELECT request_id, reviewer_label, text_hash, CASE WHEN CAST(request_id AS BIGINT) % 10 = 0 THEN TIMESTAMP '{AS_OF}' ELSE created_at END AS created_at,
      {Q.mask('rationale')} AS rationale, {Q.mask('notes')} AS notes FROM feedback""",
)
def feedback_records(spark, sf):
    df = V.answers(spark, sf)
    untimed = F.when(F.col("request_id").cast("long") % 10 > 0, F.col("created_at"))
    return R.feedback_records(df.withColumn("created_at", untimed), AS_OF)


# --- admission -----------------------------------------------------------------------

_BATCH = """batch AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'new-' || event_id ELSE CAST(event_id AS VARCHAR) END AS request_id, event_type FROM events)"""


def _batch(spark, sf):
    i = F.col("event_id").cast("string")
    return V.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("new-"), i)).otherwise(i).alias("request_id"), "event_type"
    )


def _known(spark, sf):
    return R.known_ids(V.predictions(spark, sf), V.active_sample(spark, sf))


@query(
    "feedback_unknown_ids",
    f"""WITH {Q.LOGS},{_BATCH} SELECT request_id, event_type FROM batch
    WHERE request_id NOT IN (SELECT request_id FROM predictions UNION ALL SELECT request_id FROM active)""",
)
def feedback_unknown_ids(spark, sf):
    return R.unknown_ids(_batch(spark, sf), _known(spark, sf))


@query(
    "feedback_known_ids",
    f"""WITH {Q.LOGS},{_BATCH} SELECT request_id, event_type FROM batch
    WHERE request_id IN (SELECT request_id FROM predictions UNION ALL SELECT request_id FROM active)""",
)
def feedback_known_ids(spark, sf):
    return R.recognised_ids(_batch(spark, sf), _known(spark, sf))


@query(
    "admit_feedback",
    f"""WITH {Q.LOGS}, b AS (
      SELECT CASE WHEN event_id % 301 = 0 THEN 'new-' || event_id ELSE CAST(event_id AS VARCHAR) END AS request_id, event_id // 90 AS batch FROM events),
    k AS (SELECT request_id FROM predictions UNION SELECT request_id FROM active),
    bad AS (SELECT batch FROM b GROUP BY batch HAVING count(*) > {C.MAX_FEEDBACK_BATCH} OR count(*) FILTER (WHERE request_id NOT IN (SELECT request_id FROM k)) > 0)
    SELECT request_id, batch, CASE WHEN batch IN (SELECT batch FROM bad) THEN 'rejected' ELSE 'accepted' END AS outcome FROM b""",
)
def admit_feedback(spark, sf):
    """Batches of up to ninety answers, each accepted or rejected as a whole."""
    i = F.col("event_id")
    odd = F.concat(F.lit("new-"), i.cast("string"))
    rows = V.table(spark, sf, "events").select(
        F.when(i % 301 == 0, odd).otherwise(i.cast("string")).alias("request_id"), F.floor(i / 90).alias("batch")
    )
    return R.admit_batches(rows, _known(spark, sf), "batch")


# --- reviewer labels -------------------------------------------------------------------

_NEWEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY created_at DESC, request_id DESC) AS r
  FROM feedback WHERE reviewer_label IN ('fraud', 'legit')) WHERE r = 1)"""
_LATEST = f"{Q.LOGS},{_NEWEST}"


@query("latest_feedback", f"WITH {Q.ANSWERS},{_NEWEST} SELECT text_hash, reviewer_label, created_at, request_id FROM latest")
def latest_feedback(spark, sf):
    return R.latest_feedback(V.answers(spark, sf))


_APPLIED = f"""{_LATEST},
applied AS (
  SELECT p.request_id, p.text_hash, CAST(p.model_version = 'error' AS INTEGER) AS _original_label,
    l.text_hash IS NOT NULL AS _feedback_applied,
    CASE l.reviewer_label WHEN 'fraud' THEN 1 WHEN 'legit' THEN 0 ELSE CAST(p.model_version = 'error' AS INTEGER) END AS fraudulent
  FROM predictions p LEFT JOIN latest l ON p.text_hash = l.text_hash)"""


def _applied(spark, sf):
    rows = V.predictions(spark, sf).select(
        "request_id", "text_hash", (F.col("model_version") == "error").cast("int").alias("fraudulent")
    )
    return R.apply_feedback(rows, V.feedback(spark, sf), "request_id")


@query("apply_feedback", f"WITH {_APPLIED} SELECT request_id, text_hash, _original_label, _feedback_applied, fraudulent FROM applied")
def apply_feedback(spark, sf):
    return _applied(spark, sf)


@query(
    "feedback_counts",
    f"""WITH {_APPLIED}, h AS (SELECT *, CAST('0x' || substr(md5('42|' || request_id), 1, 8) AS BIGINT) % 10000 AS b FROM applied)
    SELECT CASE WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'val' ELSE 'test' END AS split, count(*) FILTER (WHERE _feedback_applied) AS overrides
    FROM h GROUP BY 1""",
)
def feedback_counts(spark, sf):
    return R.feedback_counts(hash_split(_applied(spark, sf), "request_id"))


@query(
    "retrain_due",
    f"""WITH {Q.ANSWERS}, n AS (SELECT count(*) AS new_rows FROM feedback WHERE created_at > TIMESTAMP '2024-01-28 00:00:00')
    SELECT new_rows, CAST(4.0 AS DOUBLE) AS days, (new_rows >= 50 OR 4 >= 7) AS due FROM n""",
)
def retrain_due(spark, sf):
    return MO.retrain_due(V.answers(spark, sf), "2024-01-28 00:00:00", AS_OF)


# --- queue ---------------------------------------------------------------------------


@query("pending_predictions", f"WITH {Q.PENDING} SELECT request_id, probability, created_at FROM pending")
def pending_predictions(spark, sf):
    return R.pending(V.predictions(spark, sf), V.feedback(spark, sf)).select("request_id", "probability", "created_at")


_ENTROPY = "-(probability * log2(probability + 1e-9) + (1 - probability) * log2(1 - probability + 1e-9))"


def _queue(where: str = "true") -> str:
    return f"""{Q.PENDING},
both_ AS (
  SELECT request_id, created_at, probability, payload, 0 AS o FROM pending WHERE {where}
  UNION ALL SELECT request_id, NULL, probability, payload, 1 FROM pending_active),
queue AS (
  SELECT request_id, coalesce(created_at, TIMESTAMP '{AS_OF}') AS created_at, probability, payload, {_ENTROPY} AS entropy
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY o) AS r FROM both_) WHERE r = 1)"""


def _queue_df(spark, sf, policy, **kw):
    return R.review_queue(
        V.predictions(spark, sf), V.feedback(spark, sf), V.active_sample(spark, sf), policy=policy, as_of=AS_OF, **kw
    )


def _page(queue: str, order: str, limit: int, offset: int) -> str:
    return f"""WITH {queue}
    SELECT request_id, created_at, round(probability, 6) AS probability, payload, (SELECT count(*) FROM queue) AS total_pending
    FROM queue ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


def _page_df(queue, limit, offset, order="newest"):
    return R.queue_page(queue, limit, offset, order).select(
        "request_id", "created_at", "probability", "payload", "total_pending"
    )


@query("queue_union", f"WITH {_queue()} SELECT request_id, created_at, probability, {Q.r6('entropy')} AS entropy FROM queue")
def queue_union(spark, sf):
    return rounded(_queue_df(spark, sf, "recent").select("request_id", "created_at", "probability", "entropy"))


@query("queue_gray", _page(_queue("probability BETWEEN 0.45 AND 0.55"), "created_at DESC, request_id", 200, 0))
def queue_gray(spark, sf):
    return _page_df(_queue_df(spark, sf, "gray-zone"), 200, 0)


@query("queue_entropy", _page(_queue(), "round(entropy, 9) DESC, created_at DESC, request_id", 200, 0))
def queue_entropy(spark, sf):
    return _page_df(_queue_df(spark, sf, "entropy"), 200, 0, "uncertainty")


@query("queue_recent", _page(_queue(), "created_at DESC, request_id", 25, 0))
def queue_recent(spark, sf):
    return _page_df(_queue_df(spark, sf, "recent"), 25, 0)


@query("queue_page", _page(_queue(), "created_at DESC, request_id", 25, 300))
def queue_page(spark, sf):
    return _page_df(_queue_df(spark, sf, "recent"), 25, 300)


@query("queue_deep_page", _page(_queue(), "round(entropy, 9) DESC, created_at DESC, request_id", 25, 400))
def queue_deep_page(spark, sf):
    """A page far down the queue, from key ranges of which only the page's own is read."""
    root = scratch_path(spark, "queue-index")
    R.write_queue_index(_queue_df(spark, sf, "entropy"), root, "uncertainty", rows_per_bucket=2000)
    page = R.indexed_page(spark, root, 25, 400)
    return rounded(page.select("request_id", "created_at", "probability", "payload", "total_pending"))


def _sample(score: str) -> str:
    return f"""WITH {Q.PENDING} SELECT request_id, probability FROM (SELECT *, greatest(least(probability, 1 - 1e-6), 1e-6) AS c FROM pending)
    ORDER BY {score}, request_id LIMIT 100"""


@query("sample_entropy", _sample("round(-(c * log2(c) + (1 - c) * log2(1 - c)), 9) DESC"))
def sample_entropy(spark, sf):
    return R.sample_uncertain(V.predictions(spark, sf), V.feedback(spark, sf), 100).select("request_id", "probability")


@query("sample_margin", _sample("round(abs(probability - 0.5), 9)"))
def sample_margin(spark, sf):
    return R.sample_uncertain(V.predictions(spark, sf), V.feedback(spark, sf), 100, "margin").select("request_id", "probability")


# --- tables ----------------------------------------------------------------------------


@query(
    "latest_runs",
    f"""WITH {Q.RUNS} SELECT model_name, config_hash, "timestamp", "position", round(test_f1, 6) AS test_f1, round(val_f1, 6) AS val_f1 FROM (
      SELECT *, row_number() OVER (PARTITION BY model_name, config_hash ORDER BY "timestamp" DESC NULLS LAST, "position") AS r FROM runs)
    WHERE r = 1 ORDER BY coalesce(test_f1, 0) DESC, "position" LIMIT 20""",
)
def latest_runs(spark, sf):
    out = R.latest_runs(V.runs(spark, sf), "position")
    return rounded(out.select("model_name", "config_hash", "timestamp", "position", "test_f1", "val_f1"))


def _board(order: str) -> str:
    return f"""WITH {Q.RUNS} SELECT "position", model_name, round(val_f1, 6) AS val_f1 FROM runs ORDER BY {order}, "position" LIMIT 200"""


@query("leaderboard_sort", _board("val_f1 DESC NULLS FIRST"))
def leaderboard_sort(spark, sf):
    """Runs with NaN and null scores first, the way a descending table shows them."""
    odd = F.when(F.col("position") % 26 == 0, F.lit(float("nan"))).otherwise(F.col("val_f1"))
    df = R.sort_table(V.runs(spark, sf).withColumn("val_f1", odd), "val_f1", "desc", "position", limit=200)
    return rounded(df.select("position", "model_name", "val_f1"))


@query("leaderboard_sort_asc", _board("val_f1 ASC NULLS LAST"))
def leaderboard_sort_asc(spark, sf):
    df = R.sort_table(V.runs(spark, sf), "val_f1", "asc", "position", limit=200)
    return rounded(df.select("position", "model_name", "val_f1"))


_TOKEN_TABLE = f"""t AS (
  SELECT token, row_number() OVER (ORDER BY token) AS "position", nullif(p, 0) AS positive_count, n AS negative_count FROM (
    SELECT token, count(*) FILTER (WHERE doc_id % 2 = 0) AS p, count(*) FILTER (WHERE doc_id % 2 = 1) AS n FROM (
      SELECT doc_id, unnest(string_split_regex(text, '{C.WS}+')) AS token FROM documents) WHERE token <> '' GROUP BY token))"""


@query(
    "token_sort",
    f"""WITH {_TOKEN_TABLE} SELECT token, positive_count, negative_count FROM t ORDER BY positive_count ASC NULLS LAST, token LIMIT 500 OFFSET 100""",
)
def token_sort(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", F.explode(X.split_tokens("text")).alias("token"))
    even = F.col("doc_id") % 2 == 0
    table = rows.groupBy("token").agg(
        F.count_if(even).alias("p"), F.count_if(~even).alias("negative_count"), F.count("*").alias("n")
    )
    table = table.withColumn("positive_count", F.when(F.col("p") > 0, F.col("p")))
    out = R.sort_table(table, "positive_count", "asc", "token", limit=500, offset=100)
    return out.select("token", "positive_count", "negative_count")


@query(
    "table_head",
    f"""WITH {Q.RUNS} SELECT model_name, round(test_f1, 6) AS test_f1, "position" FROM runs ORDER BY "position" LIMIT 50""",
)
def table_head(spark, sf):
    """A stored report table with every column as text, read back typed."""
    root = scratch_path(spark, "tables")
    runs = V.runs(spark, sf).select("position", "model_name", F.round("test_f1", 6).alias("test_f1"))
    logs.write_report_tables({"runs": runs}, root)
    stored = logs.read_report_table(spark, root, "runs", "position string, model_name string, test_f1 string")
    return R.table_head(stored, "position", 50, {"model_name": "string", "test_f1": "double", "position": "bigint"})


@query("latency_summary", """SELECT l_linenumber AS batch_size, round(quantile_cont(l_extendedprice, 0.5), 6) AS latency_p50_ms,
      round(quantile_cont(l_extendedprice, 0.95), 6) AS latency_p95_ms, round(avg(l_quantity), 6) AS throughput_rps FROM lineitem GROUP BY 1""")
def latency_summary(spark, sf):
    return rounded(MO.latency_summary(V.latency(spark, sf)))


@query("benchmark_summary", """SELECT l_linenumber AS batch_size, round(avg(l_extendedprice), 6) AS mean_latency_ms,
      round(stddev_samp(l_extendedprice), 6) AS std_latency_ms, round(avg(l_quantity), 6) AS mean_throughput_rps FROM lineitem GROUP BY 1""")
def benchmark_summary(spark, sf):
    return rounded(MO.benchmark_summary(V.latency(spark, sf)))


# --- chat ------------------------------------------------------------------------------


@query(
    "chat_last_turns",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, text AS content FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10""",
)
def chat_last_turns(spark, sf):
    return R.last_turns(V.table(spark, sf, "conversations"))


def _fixed(x: str, n: int) -> str:
    return f"CAST(CAST(round({x} + sign({x}) * 1e-12, {n}) AS DECIMAL(30,{n})) AS VARCHAR)"


def _lines_sql(sign: str, title: str) -> str:
    return f"""(SELECT chr(10) || '{title}:' || chr(10) || string_agg('  - ' || feature || ': ' || {_fixed('contribution', 3)}, chr(10) ORDER BY rank)
      FROM tops t WHERE t.doc_id = s.doc_id AND sign = '{sign}')"""


def _chat_sql() -> str:
    from siftline.plans.queries_text import _CONTRIBUTIONS

    return f"""WITH {_CONTRIBUTIONS}, tops AS (SELECT doc_id, sign, rank, feature, round(contribution, 6) AS contribution FROM ranked WHERE rank <= 5),
    s AS (SELECT scored.*, title, description FROM scored JOIN postings USING (doc_id))
    SELECT doc_id, 'Context from the fraud detection pipeline:' || chr(10) || concat_ws(chr(10),
      CASE WHEN ({' OR '.join(f'contains(lower(description), {Q.quote(k)})' for k in C.POSTING_KEYWORDS)}) AND length(description) > 200
        THEN '=== MESSAGE CLASSIFICATION ===' || chr(10) || 'Heuristic Assessment: Potential job posting based on keywords.' END,
      '=== FRAUD DETECTION ANALYSIS ===', 'Fraud Probability: ' || {_fixed('probability * 100', 1)} || '%',
      'Decision: ' || CASE WHEN probability >= 0.55 THEN 'fraud' WHEN probability <= 0.45 THEN 'legit' ELSE 'review' END,
      'Classification: ' || CASE WHEN probability >= 0.5 THEN 'FRAUDULENT' ELSE 'LEGITIMATE' END,
      {_lines_sql('positive', 'Top Fraud Indicators')}, {_lines_sql('negative', 'Top Legitimacy Signals')},
      chr(10) || 'Based on this analysis, provide a detailed but concise explanation of:', '1. Whether this job posting appears fraudulent and why',
      '2. The main red flags or positive signals', '3. Actionable advice for the job seeker',
      chr(10) || 'Job Posting Details:', CASE WHEN title <> '' THEN '- Title: ' || title END, '- Description: ' || left(description, 300) || '...',
      '- Employment Type: ' || employment_type) || chr(10) || chr(10) || 'Original user message:' || chr(10) || 'Is this real?' AS message FROM s"""


@query("chat_context", _chat_sql())
def chat_context(spark, sf):
    """The message a reader's question becomes, for every document."""
    rows = E.contribution_rows(V.featured(spark, sf), "text_all", "doc_id", V.model(spark))
    why = E.explanations(rows, "doc_id", V.MODEL_INTERCEPT)
    scored = D.decide(V.scored(spark, sf), "probability", V.THRESHOLD)
    df = V.postings(spark, sf).select("doc_id", "title", "description", "employment_type")
    df = df.join(scored.select("doc_id", "probability_fraud", "decision", "binary_label"), "doc_id").join(why, "doc_id", "left")

    def short(items):
        return F.transform(items, lambda s: F.struct(s["feature"].alias("feature"), F.round(s["contribution"], 6).alias("contribution")))

    message = E.chat_message(
        F.lit("Is this real?"),
        F.when(X.looks_like_posting("description"), E.heuristic_block()),
        E.detection_block("probability_fraud", "decision", "binary_label", short(F.col("top_positive")), short(F.col("top_negative"))),
        E.posting_block(["title", "description", "employment_type"]),
    )
    return df.select("doc_id", message.alias("message"))


# --- streams ---------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream: its single file, with the schema of the batch read."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


@query(
    "stream_score",
    f"""WITH {Q.SCORED}
    SELECT sha256('stream-0|' || s.doc_id) AS request_id, probability,
      CASE WHEN probability >= 0.55 THEN 'fraud' WHEN probability <= 0.45 THEN 'legit' ELSE 'review' END AS predicted_label,
      sha256(text_all) AS text_hash, '20240201' AS date FROM scored s JOIN clean c ON s.doc_id = c.doc_id""",
)
def stream_score(spark, sf):
    """Documents as a stream, scored into the prediction log, read back."""
    root = scratch_path(spark, "stream-log")
    docs = _stream(spark, sf, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), "lang",
        F.lit(1).alias("has_company_logo"), F.lit(AS_OF).cast("timestamp").alias("created_at"),
    )
    q = score_stream(docs, lambda batch, key: _log(spark, V.spread(batch), key), root, scratch_path(spark, "stream-state"))
    q.awaitTermination()
    return logs.read_log(spark, root).select("request_id", "probability", "predicted_label", "text_hash", "date")


def _answer_stream(spark, sf):
    """Events as a stream of answers, a third of them with ids nobody logged."""
    i = F.col("event_id").cast("string")
    return _stream(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("new-"), i)).otherwise(i).alias("request_id"),
        F.lit("fraud").alias("reviewer_label"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("props").alias("notes"),
    )


def _outcomes(spark, root):
    parts = [
        spark.read.parquet(f"{root}/{kind}").select(F.lit(kind).alias("outcome"), "request_id")
        for kind in ("accepted", "rejected")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stream_feedback",
    f"""WITH {Q.LOGS},{_BATCH}
    SELECT CASE WHEN request_id IN (SELECT request_id FROM predictions UNION ALL SELECT request_id FROM active)
      THEN 'accepted' ELSE 'rejected' END AS outcome, request_id FROM batch""",
)
def stream_feedback(spark, sf):
    """Feedback as a stream, a third of it with ids nobody logged."""
    root = scratch_path(spark, "stream-feedback")
    rows = _answer_stream(spark, sf)
    q = admit_stream(rows, lambda: _known(spark, sf), root, scratch_path(spark, "stream-state"))
    q.awaitTermination()
    return _outcomes(spark, root)


@query(
    "stream_admission",
    f"""WITH {Q.PREDICTIONS},{_BATCH}
    SELECT CASE WHEN request_id IN (SELECT request_id FROM predictions) THEN 'accepted' ELSE 'rejected' END AS outcome, request_id FROM batch""",
)
def stream_admission(spark, sf):
    """The same feedback against a stream of predictions, known ids and answers held as state."""
    root = scratch_path(spark, "stream-admission")
    logged = _stream(spark, sf, "events").select(F.col("event_id").cast("string").alias("request_id"))
    q = admit_by_state(_answer_stream(spark, sf), logged, root, scratch_path(spark, "stream-state"))
    q.awaitTermination()
    return _outcomes(spark, root)
