"""Sources, sinks, labels, de-duplication, splits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions.text import concat_fields
from siftline.operators import ingest as I
from siftline.operators import split as S
from siftline.operators.policy import decide
from siftline.operators.review import log_records, sample_uncertain
from siftline.plans import sql_parts as Q
from siftline.plans.catalog import query
from siftline.session import scratch_path
from siftline.sources import logs, postings as P
from siftline.sources import views as V

# --- sources and sinks -------------------------------------------------------------


@query("read_csv_sources")
def read_csv_sources(spark, sf):
    """Two overlapping CSV files and a missing one, written from the documents."""
    root = scratch_path(spark, "csv")
    df = V.postings(spark, sf).withColumns(
        {"job_id": F.col("doc_id"), "fraudulent": (F.col("doc_id") % 2).cast("string")}
    ).select("job_id", "title", "description", "has_company_logo", "industry", "fraudulent")
    parts = {
        "first.csv": df.filter("job_id % 3 < 2"),
        "second.csv": df.filter("job_id % 3 > 0").withColumnRenamed("industry", " In-Dustry "),
    }
    for name, part in parts.items():
        part.write.csv(f"{root}/{name}", header=True, quote='"', escape='"', nullValue="NA")
    return P.read_postings(spark, root, list(parts))


@query(
    "normalize_columns",
    "SELECT page_id, url AS page_url, length(html) AS html_length_n FROM pages",
)
def normalize_columns(spark, sf):
    pages = V.table(spark, sf, "pages")
    return P.normalize_columns(
        pages.select(
            F.col("page_id").alias(" Page ID "),
            F.col("url").alias("__Page--URL__"),
            F.length("html").cast("bigint").alias("HTML length (n)"),
        )
    )


@query(
    "union_sources",
    """
    SELECT doc_id, text, lang, CAST(NULL AS VARCHAR) AS url, 'documents' AS _source_file, 0 AS _source_rank
    FROM documents
    UNION ALL
    SELECT page_id, html, NULL, url, 'pages', 1 FROM pages
    """,
)
def union_sources(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text", "lang")
    pages = V.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url"
    )
    return P.union_sources([("documents", docs), ("pages", pages)])


@query(
    "write_splits",
    """SELECT split, count(*) AS "rows" FROM (
      SELECT CASE WHEN h % 10000 < 7000 THEN 'train' WHEN h % 10000 < 8500 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT CAST('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents)) GROUP BY split""",
)
def write_splits(spark, sf):
    root = scratch_path(spark, "splits")
    logs.write_splits(S.hash_split(V.postings(spark, sf), "doc_id"), root)
    return spark.read.parquet(root).groupBy("split").agg(F.count("*").alias("rows"))


@query(
    "append_log",
    """SELECT CASE WHEN event_id % 2 = 0 THEN '20240101' ELSE '20240102' END AS date, count(*) AS "rows" FROM events GROUP BY 1""",
)
def append_log(spark, sf):
    """Events appended in two batches under different days."""
    root = scratch_path(spark, "log")
    rows = V.predictions(spark, sf)
    logs.append_log(rows.filter("cast(request_id as bigint) % 2 = 0"), root, "20240101")
    logs.append_log(rows.filter("cast(request_id as bigint) % 2 = 1"), root, "20240102")
    return logs.read_log(spark, root).groupBy("date").agg(F.count("*").alias("rows"))


@query(
    "read_log_by_date",
    f"""WITH {Q.PREDICTIONS}
    SELECT request_id, created_at, model_version, probability, text_hash,
      strftime(created_at, '%Y%m%d') AS date
    FROM predictions WHERE strftime(created_at, '%Y%m%d') BETWEEN '20240105' AND '20240112'""",
)
def read_log_by_date(spark, sf):
    """The events written by day, read back for a week: only its folders are scanned."""
    root = scratch_path(spark, "days")
    rows = V.predictions(spark, sf).withColumn("date", F.date_format("created_at", "yyyyMMdd"))
    rows.write.partitionBy("date").parquet(root)
    week = logs.read_log(spark, root, since="20240105", until="20240112")
    return week.select("request_id", "created_at", "model_version", "probability", "text_hash", "date")


@query("read_active_sample")
def read_active_sample(spark, sf):
    path = scratch_path(spark, "active")
    sample = sample_uncertain(V.predictions(spark, sf), V.feedback(spark, sf), 100)
    logs.write_active_sample(sample, path)
    return logs.read_active_sample(spark, path)


@query("append_run")
def append_run(spark, sf):
    """The best run of the table, appended to a run log twice."""
    root = scratch_path(spark, "runs")
    columns = ["model_name", "config_hash", "timestamp", "test_f1", "val_f1", "threshold", "calibration_method"]
    row = V.runs(spark, sf).agg(F.max_by(F.struct(*columns), F.struct("test_f1", "position")).alias("r")).first()["r"]
    for kind in ("classical", "ensemble"):
        logs.append_run(spark, {**row.asDict(), "model_type": kind}, root)
    return logs.read_runs(spark, root)


@query("write_report_tables")
def write_report_tables(spark, sf):
    root = scratch_path(spark, "report")
    df = V.postings(spark, sf)
    tables = {
        "missingness": I.missingness(df),
        "sources": df.groupBy("source").agg(F.count("*").alias("rows")),
        "absent": None,
        "empty": df.filter("doc_id < 0"),
    }
    written = logs.write_report_tables(tables, root)
    out = None
    for name in written:
        rows = logs.read_report_table(spark, root, name, "name string, value double")
        rows = rows.select(F.lit(name).alias("table"), "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "run_metrics_long",
    f"""WITH {Q.RUNS}
    SELECT "position" AS run, 'test_f1' AS metric, test_f1 AS value FROM runs WHERE test_f1 IS NOT NULL
    UNION ALL
    SELECT "position", 'val_f1', val_f1 FROM runs WHERE val_f1 IS NOT NULL""",
)
def run_metrics_long(spark, sf):
    return logs.run_metrics_long(V.runs(spark, sf), "position", ["test_f1", "val_f1"])


@query(
    "test_predictions",
    f"""WITH {Q.LABELLED}
    SELECT probability AS prob_fraud, fraudulent AS label,
      CASE WHEN probability >= 0.55 THEN 'fraud' WHEN probability <= 0.45 THEN 'legit' ELSE 'review' END AS decision
    FROM labelled""",
)
def test_predictions(spark, sf):
    """The scored test set, written and read back."""
    path = scratch_path(spark, "scored")
    scored = decide(V.labelled(spark, sf), "probability", V.THRESHOLD).select(
        F.col("probability_fraud").alias("prob_fraud"), F.col("fraudulent").alias("label"), "decision"
    )
    scored.write.parquet(path)
    return spark.read.parquet(path)


# --- labels, filters, projections ----------------------------------------------------

_RAW_LABEL = """CASE doc_id % 6 WHEN 0 THEN ' Real' WHEN 1 THEN 'FAKE ' WHEN 2 THEN '1' WHEN 3 THEN '0.0'
  WHEN 4 THEN 'unknown' END"""


@query(
    "coerce_label",
    f"""SELECT doc_id, CAST(CASE lower(trim(raw)) WHEN 'real' THEN 0 WHEN 'fake' THEN 1
        ELSE TRY_CAST(raw AS DOUBLE) END AS INTEGER) AS fraudulent
    FROM (SELECT doc_id, {_RAW_LABEL} AS raw FROM documents)
    WHERE lower(trim(raw)) IN ('real', 'fake') OR TRY_CAST(raw AS DOUBLE) IS NOT NULL""",
)
def coerce_label(spark, sf):
    raw = V.table(spark, sf, "documents").select("doc_id", F.expr(_RAW_LABEL).alias("fraudulent"))
    return I.coerce_label(raw)


@query(
    "fill_missing",
    f"""WITH {Q.POSTINGS}
    SELECT doc_id, coalesce(title, '<missing>') AS title, coalesce(required_experience, '<missing>') AS required_experience,
      CASE WHEN doc_id % 4 > 0 THEN doc_id END AS some_number FROM postings""",
)
def fill_missing(spark, sf):
    df = V.postings(spark, sf).withColumn("some_number", F.expr("CASE WHEN doc_id % 4 > 0 THEN doc_id END"))
    return I.fill_missing(df.select("doc_id", "title", "required_experience", "some_number"))


@query("drop_columns", f"WITH {Q.POSTINGS} SELECT doc_id, title, industry, source FROM postings")
def drop_columns(spark, sf):
    df = V.postings(spark, sf).select(
        "doc_id", "title", "industry", "source", F.col("lang").alias("location"), F.col("lang").alias("department")
    )
    return I.drop_columns(df)


@query(
    "scoring_payload",
    f"""WITH {Q.POSTINGS}
    SELECT doc_id, title, CAST(TRY_CAST(telecommuting AS DOUBLE) AS INTEGER) AS telecommuting, has_company_logo,
      has_questions, industry, CASE WHEN doc_id % 3 > 0 THEN doc_id / 2.0 END AS pay FROM postings""",
)
def scoring_payload(spark, sf):
    pay = F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("doc_id") / 2.0)
    df = V.postings(spark, sf).select(
        "doc_id", "title", F.expr("try_cast(telecommuting as double)").alias("telecommuting"),
        "has_company_logo", "has_questions", "industry", pay.alias("pay"),
        F.lit(1).alias("fraudulent"), F.col("description").alias("text_all"),
    )
    return I.scoring_payload(df)


@query(
    "align_features",
    f"""WITH {Q.POSTINGS}
    SELECT title, description, industry, CAST(NULL AS VARCHAR) AS benefits,
      coalesce(TRY_CAST(telecommuting AS INTEGER), 0) AS telecommuting, has_company_logo, 0 AS has_photo,
      CAST(0.0 AS DOUBLE) AS scam_term_ssn FROM postings""",
)
def align_features(spark, sf):
    df = V.postings(spark, sf).withColumn("telecommuting", F.expr("try_cast(telecommuting as int)"))
    wanted = {
        "title": None, "description": None, "industry": None, "benefits": None,
        "telecommuting": 0, "has_company_logo": 0, "has_photo": 0, "scam_term_ssn": 0.0,
    }
    types = {"benefits": "string", "has_photo": "int", "scam_term_ssn": "double"}
    return I.align_columns(df, wanted, types=types)


# --- de-duplication ------------------------------------------------------------------

_TWO_SOURCES = f"""{Q.POSTINGS},
merged AS (
  SELECT 0 AS _source_rank, doc_id AS job_id, title, employment_type, industry, description FROM postings
  UNION ALL
  SELECT 1, doc_id + 1000000, title, employment_type, industry, 'again ' || description FROM postings
  WHERE doc_id % 3 < 2)"""


def _two_sources(spark, sf):
    cut = V.postings(spark, sf).select(
        "doc_id", "title", "employment_type", "industry", "description"
    )
    first = cut.withColumnRenamed("doc_id", "job_id")
    second = cut.filter("doc_id % 3 < 2").select(
        (F.col("doc_id") + 1000000).alias("job_id"), "title", "employment_type", "industry",
        F.concat(F.lit("again "), "description").alias("description"),
    )
    return P.union_sources([("a", first), ("b", second)])


@query(
    "dedup_key",
    f"""WITH {_TWO_SOURCES}
    SELECT job_id, title, employment_type, industry, length(description) AS chars, _source_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY title, employment_type, industry ORDER BY _source_rank, job_id) AS r
      FROM merged) WHERE r = 1""",
)
def dedup_key(spark, sf):
    """Two sources; location, requirements, function and label are absent and count as blank."""
    return I.dedup_key(_two_sources(spark, sf)).select(
        "job_id", "title", "employment_type", "industry", F.length("description").cast("bigint").alias("chars"), "_source_rank"
    )


@query(
    "dedup_checksum",
    """SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY text""",
)
def dedup_checksum(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return I.dedup_checksum(docs, ["text"], ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(
    "dedup_stats",
    f"""WITH {_TWO_SOURCES}
    SELECT count(*) AS rows_before, count(DISTINCT (title, employment_type, industry)) AS rows_after,
      count(*) - count(DISTINCT (title, employment_type, industry)) AS dropped FROM merged""",
)
def dedup_stats(spark, sf):
    return I.dedup_stats(_two_sources(spark, sf), I.joined_key(["title", "employment_type", "industry"]))


# --- splits and samples --------------------------------------------------------------

_HASH = "CAST('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)"
_SPLIT = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY has_company_logo ORDER BY {_HASH}, doc_id) AS r,
    count(*) OVER (PARTITION BY has_company_logo) AS n FROM postings),
splits AS (
  SELECT doc_id, has_company_logo, CASE WHEN r <= floor(n * 0.7 + 0.5) THEN 'train'
    WHEN r <= floor(n * 0.85 + 0.5) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def _split(spark, sf):
    df = V.postings(spark, sf).select("doc_id", "has_company_logo")
    return S.stratified_split(df, "doc_id", "has_company_logo")


@query("stratified_split", f"WITH {Q.POSTINGS},{_SPLIT} SELECT doc_id, has_company_logo, split FROM splits")
def stratified_split(spark, sf):
    return _split(spark, sf)


@query(
    "hash_split",
    f"""SELECT doc_id, CASE WHEN {_HASH} % 10000 < 7000 THEN 'train' WHEN {_HASH} % 10000 < 8500 THEN 'val'
      ELSE 'test' END AS split FROM documents""",
)
def hash_split(spark, sf):
    return S.hash_split(V.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "split_summary",
    f"""WITH {Q.POSTINGS},{_SPLIT}
    SELECT split, count(*) AS "rows", round(avg(has_company_logo), 6) AS positive_share FROM splits GROUP BY split""",
)
def split_summary(spark, sf):
    return S.split_summary(_split(spark, sf), "has_company_logo").withColumn(
        "positive_share", F.round("positive_share", 6)
    )


@query("split_ids_roundtrip", f"WITH {Q.POSTINGS},{_SPLIT} SELECT doc_id, title, split FROM splits JOIN postings USING (doc_id)")
def split_ids_roundtrip(spark, sf):
    root = scratch_path(spark, "ids")
    logs.write_split_ids(_split(spark, sf), "doc_id", root)
    stored = logs.read_split_ids(spark, root)
    return V.postings(spark, sf).join(stored, "doc_id").select("doc_id", "title", "split")


@query(
    "sample_batch",
    f"""WITH {Q.POSTINGS}, s AS (SELECT doc_id, title, row_number() OVER (ORDER BY {_HASH}, doc_id) - 1 AS p FROM postings),
    k AS (SELECT *, (SELECT least(count(*), 128) FROM s) AS n FROM s WHERE p < 128)
    SELECT doc_id, title, CAST(unnest(range(0, CAST(floor((127 - p) / n) AS BIGINT) + 1)) AS INTEGER) AS draw FROM k""",
)
def sample_batch(spark, sf):
    return S.sample_batch(V.postings(spark, sf).select("doc_id", "title"), "doc_id", 128)


# --- profiles --------------------------------------------------------------------------


@query(
    "missingness",
    f"""WITH {Q.POSTINGS}, shares AS (
      SELECT avg(CAST(title IS NULL AS INTEGER)) AS title, avg(CAST(required_experience IS NULL AS INTEGER)) AS required_experience,
        avg(CAST(industry IS NULL AS INTEGER)) AS industry FROM postings)
    SELECT "column", round(null_share, 6) AS null_share FROM (
      SELECT 'title' AS "column", title AS null_share FROM shares
      UNION ALL SELECT 'required_experience', required_experience FROM shares
      UNION ALL SELECT 'industry', industry FROM shares)""",
)
def missingness(spark, sf):
    out = I.missingness(V.postings(spark, sf), ["title", "required_experience", "industry"])
    return out.withColumn("null_share", F.round("null_share", 6)).orderBy(F.col("null_share").desc(), "column")


@query("class_counts", 'SELECT toxic AS label, count(*) AS "rows" FROM labels GROUP BY toxic')
def class_counts(spark, sf):
    return I.class_counts(V.labels(spark, sf))


@query(
    "length_histogram",
    """WITH rows_ AS (SELECT length(text) AS n, toxic FROM documents JOIN labels USING (doc_id)),
    ends AS (SELECT min(n) AS low, max(n) AS high FROM rows_)
    SELECT toxic AS label, CAST(CASE WHEN high = low THEN 0 ELSE least(59, (n - low) * 60 // (high - low)) END AS INTEGER) AS bin,
      count(*) AS "rows"
    FROM rows_, ends GROUP BY 1, 2""",
)
def length_histogram(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return I.length_histogram(docs.join(V.labels(spark, sf), "doc_id"), "n", "fraudulent")
