"""Partitioned logs and report tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import constants as C
from siftline.operators.review import FEEDBACK_SCHEMA, PREDICTION_SCHEMA

RUN_SCHEMA = ", ".join(
    f"{c} {'timestamp' if c == 'timestamp' else 'double' if c == 'threshold' or c[:4] in ('val_', 'test') else 'string'}"
    for c in C.RUN_COLUMNS
)


def append_log(rows: DataFrame, root: str, day: str | None = None) -> None:
    """Append a batch under `date=yyyyMMdd`; an empty batch is an error.

    The date is the day given, else today in UTC, set once for the whole batch so that a
    retried task cannot land in another folder. Rows are counted as they are written.
    """
    day = day or datetime.now(timezone.utc).strftime("%Y%m%d")
    seen = Observation()
    counted = rows.withColumn("date", F.lit(day)).observe(seen, F.count("*").alias("rows"))
    counted.write.mode("append").partitionBy("date").parquet(root)
    if not seen.get["rows"]:
        raise ValueError("no rows to append")


def read_log(
    spark: SparkSession,
    root: str,
    schema: str = PREDICTION_SCHEMA,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """The log with its `date`; only the folders between the two days are read.

    A missing or empty root gives an empty frame of the declared schema.
    """
    full = f"{schema}, date string"
    try:
        log = spark.read.schema(full).option("basePath", root).parquet(root)
        log = log.select(*[f.split()[0] for f in full.split(", ")])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    if since:
        log = log.filter(F.col("date") >= since)
    if until:
        log = log.filter(F.col("date") <= until)
    return log


def read_feedback(spark: SparkSession, root: str, **days) -> DataFrame:
    return read_log(spark, root, FEEDBACK_SCHEMA, **days)


def read_active_sample(spark: SparkSession, path: str) -> DataFrame | None:
    """The sampled queue, or nothing when absent, empty or without its key columns."""
    try:
        table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if not {"request_id", "probability"} <= set(table.columns) or table.isEmpty():
        return None
    typed = {"probability": "double", "threshold": "double", "created_at": "timestamp"}
    return table.withColumns(
        {c: F.col(c).try_cast(t) for c, t in typed.items() if c in table.columns}
    )


def write_active_sample(sample: DataFrame, path: str) -> None:
    """A review sample is a top-n, so one file holds it."""
    kept = [c for c in sample.columns if not c.startswith("_")]
    sample.select(*kept).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def append_run(spark: SparkSession, record: Mapping[str, object], root: str) -> None:
    """Append one run with the twelve declared columns."""
    unknown = sorted(set(record) - set(C.RUN_COLUMNS))
    if unknown:
        raise ValueError(f"unknown run columns: {unknown}")
    row = {c: record.get(c) for c in C.RUN_COLUMNS}
    row["calibration_method"] = row["calibration_method"] or ""
    for name, value in row.items():
        if name == "threshold" or name[:4] in ("val_", "test"):
            row[name] = None if value is None else float(value)
    spark.createDataFrame([tuple(row.values())], RUN_SCHEMA).write.mode("append").parquet(root)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_SCHEMA)


def write_splits(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(root)


def write_split_ids(df: DataFrame, key: str, root: str) -> None:
    """Only (key, split): enough to rebuild the splits from the postings."""
    df.select(key, "split").write.mode("overwrite").parquet(root)


def read_split_ids(spark: SparkSession, root: str) -> DataFrame:
    """Stored assignment; an absent one is an error."""
    try:
        return spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"split table missing: {root}") from error


def write_report_tables(
    tables: Mapping[str, DataFrame | None], root: str, fmt: str = "csv"
) -> list[str]:
    """One folder per result table; absent and empty ones are skipped."""
    written = []
    for name, table in tables.items():
        if table is None or table.isEmpty():
            continue
        flat = table.select(
            *[
                F.to_json(f.name).alias(f.name)
                if fmt == "csv" and isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
                else F.col(f.name)
                for f in table.schema.fields
            ]
        )
        writer = flat.write.mode("overwrite")
        path = f"{root.rstrip('/')}/{name}"
        writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
        written.append(name)
    return written


def read_report_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A stored CSV table; a missing one is empty."""
    try:
        return spark.read.schema(schema).csv(f"{root.rstrip('/')}/{name}", header=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_metrics_long(runs: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(run, metric, value) of the metrics a run has; nulls are skipped."""
    long = runs.select(F.col(key).alias("run"), *[F.col(n).cast("double").alias(n) for n in names])
    return long.unpivot("run", names, "metric", "value").filter(F.col("value").isNotNull())
