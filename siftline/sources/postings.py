"""Reading and merging posting files."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import constants as C

# Texts read as missing, besides the empty field.
NULL_TEXTS = (
    "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "#N/A", "<NA>",
    "-NaN", "-nan", "#NA", "#N/A N/A", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN",
)

_INT_COLUMNS = ("job_id", *C.FLAG_FIELDS)
POSTING_SCHEMA = T.StructType(
    [
        T.StructField(c, T.LongType() if c in _INT_COLUMNS else T.StringType())
        for c in C.POSTING_COLUMNS
    ]
)


def normalize_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names with single underscores; two equal results are an error."""
    names = [normalize_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns with the same normalised name: {clashes}")
    return df.toDF(*names)


def null_texts(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*NULL_TEXTS, ""), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def conform(df: DataFrame, schema: T.StructType = POSTING_SCHEMA) -> DataFrame:
    """Cast the declared columns that are present; other columns stay as they are."""
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(
        *[
            F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def missing_columns(df: DataFrame, expected: Sequence[str] = C.POSTING_COLUMNS) -> list[str]:
    """Declared columns the frame lacks."""
    return [c for c in expected if c not in df.columns]


def read_postings(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Merge the CSV files that exist under `folder`, in the order given.

    A missing file is a warning, no file at all an error. Columns are matched by
    normalised name; `_source_file` and `_source_rank` say where a row came from.
    """
    frames = []
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        try:
            raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"dataset file missing: {path}", stacklevel=2)
            continue
        frames.append((name, conform(null_texts(normalize_columns(raw)))))
    if not frames:
        raise FileNotFoundError(f"no dataset files under {folder}: {', '.join(names)}")
    return union_sources(frames)


def union_sources(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Outer union by column name with the source name and its position."""
    merged = None
    for rank, (name, df) in enumerate(frames):
        tagged = df.withColumn("_source_file", F.lit(name)).withColumn("_source_rank", F.lit(rank))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged
