"""Line de-duplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import words as wd
from siftline.session import scratch_path

#: A line on this share of a host's pages is boilerplate, if it is on MIN_PAGES at least.
RATIO, MIN_PAGES = 0.1, 5
#: Largest list of boilerplate lines that is broadcast, in bytes as measured on the written list; a
#: larger one is joined by a shuffle.
MAX_BROADCAST_BYTES = 64 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate_lines(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line_md5, pages, host_pages): lines on at least `ratio` of their host's pages.

    Pages of a host with equal texts count as one page, above and below the line of the
    fraction, so copies of a page do not turn its lines into boilerplate. Blank lines are layout and
    never counted. A null host is a host. Counting is by (host, line) after (host, page, line)
    has lost its repeats, so neither a large host nor a common line meets in one task
    before it is combined.
    """
    pages = docs.filter(F.col(text).isNotNull()).select(
        F.col(host).alias("host"), F.md5(text).alias("page"), F.col(text).alias("text")
    )
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    each = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.md5(x)))
    lines = pages.select("host", "page", F.explode(each).alias("line_md5")).distinct()
    counts = lines.groupBy("host", "line_md5").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = totals.withColumnRenamed("host", "_host")
    joined = counts.join(totals, F.col("host").eqNullSafe(F.col("_host")))
    return joined.filter(F.col("pages") >= F.col("host_pages") * ratio).drop("_host")


def _written_list(lines: DataFrame) -> DataFrame:
    """(host, bad): the boilerplate lines of each host, from a table that is written once, broadcast
    if its measured size allows.

    A host's list is short by its ratio: there are at most 1 / ratio times as many such lines as an average
    page of the host has lines.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "boilerplate")
    lines.groupBy("host").agg(F.collect_set("line_md5").alias("bad")).write.parquet(path)
    bad = spark.read.parquet(path)
    held = F.coalesce(F.octet_length("host"), F.lit(0)) + 64 + F.size("bad") * 48
    size = bad.agg(F.sum(held.cast("long"))).first()[0] or 0
    return F.broadcast(bad) if size <= MAX_BROADCAST_BYTES else bad


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counts: bool = True,
) -> DataFrame:
    """`docs` with boilerplate lines cut out of `text`, and `n_lines`, `n_dropped` (long) if asked.

    Kept lines stay in order, joined by line breaks. Every row stays: a page of nothing but
    boilerplate has an empty text, a null text stays null with 0 lines, an empty text has one
    (blank) line. Repeated rows are each handled; other columns pass through whatever their names, and
    columns named like the two counts are replaced where those are asked for. The list of boilerplate
    is worked out here, once, into a table of the shared folder.
    """
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    site, bad, left = (wd.free_name(docs.columns, n) for n in ("_site", "_bad", "_left"))
    listed = _written_list(boilerplate_lines(docs, host, text, ratio, min_pages))
    listed = listed.withColumnsRenamed({"host": site, "bad": bad})
    df = docs.select(*dict.fromkeys([*columns, host, text]))
    df = df.join(listed, df[host].eqNullSafe(F.col(site)), "left")
    lines = _lines(F.col(text))
    good = F.filter(lines, lambda x: ~F.array_contains(bad, F.md5(x)))
    df = df.withColumn(left, F.when(F.col(bad).isNotNull(), good).otherwise(lines))
    kept = F.when(F.col(bad).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))
    out = [kept.alias(text) if c == text else F.col(c) for c in columns]
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
        rest = F.when(F.col(text).isNull(), 0).otherwise(F.size(left))
        out += [n.cast("long").alias("n_lines"), (n - rest).cast("long").alias("n_dropped")]
    return df.select(*out)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs)


SQL = f"""
WITH p AS (SELECT DISTINCT source, md5(text) AS page, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT source, count(*) AS n FROM p GROUP BY source),
l AS (SELECT DISTINCT source, page, line FROM (SELECT source, page, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line, ' ') <> ''),
c AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= {MIN_PAGES}),
b AS (
    SELECT c.source, list(c.line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
    WHERE c.n >= t.n * CAST({RATIO} AS DOUBLE) GROUP BY c.source),
d AS (
    SELECT doc_id, d.source, text, string_split(text, chr(10)) AS lines, bad
    FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM d)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
    CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""
