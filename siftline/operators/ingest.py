"""Labels, missing values, de-duplication and profiles of posting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import constants as C
from siftline.functions import text as X
from siftline.functions.scalars import lenient_double


def coerce_label(df: DataFrame, label: str = "fraudulent") -> DataFrame:
    """Words or numbers to an integer label; rows without one are dropped."""
    if label not in df.columns:
        raise KeyError(f"label column {label!r} is missing")
    word = F.lower(X.trim_ws(F.col(label).cast("string")))
    value = F.when(word == "real", 0.0).when(word == "fake", 1.0).otherwise(lenient_double(label))
    return (
        df.withColumn(label, value)
        .filter(F.col(label).isNotNull() & ~F.isnan(label))
        .withColumn(label, F.col(label).cast("int"))
    )


def fill_missing(df: DataFrame, value: str = C.MISSING) -> DataFrame:
    """Null text becomes `value`; numbers stay null."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(value, subset=names) if names else df


def drop_columns(df: DataFrame, names: Sequence[str] = C.DROP_COLUMNS) -> DataFrame:
    return df.drop(*names)


def preprocess(
    df: DataFrame,
    *,
    text_fields: Sequence[str] = C.TEXT_FIELDS,
    drop: Sequence[str] = C.DROP_COLUMNS,
    **cleaning,
) -> DataFrame:
    """Fill, clean each text field, add `text_all`, drop columns that leak the label."""
    df = fill_missing(df)
    present = [f for f in text_fields if f in df.columns]
    df = df.withColumns({f: X.clean_text(f, **cleaning) for f in present})
    return drop_columns(df.withColumn("text_all", X.concat_fields(present)), drop)


def add_absent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})


def joined_key(names: Sequence[str]) -> Column:
    """Key text: null as '', parts joined by two bars."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    return F.concat_ws("||", *parts)


def keep_first(df: DataFrame, key: Column, order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the declared order.

    `min_by` combines on the map side, so a group holding a third of all rows leaves
    each task as one row; the key itself travels as a 32-byte digest.
    """
    order = [X.col_of(o) for o in order]
    return (
        df.groupBy(F.unhex(F.sha2(key, 256)).alias("_key"))
        .agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def dedup_key(
    df: DataFrame,
    order: Sequence[str | Column] = ("_source_rank", "job_id"),
    key: Sequence[str] = C.DEDUP_KEY,
) -> DataFrame:
    """First posting per key; key columns the frame lacks are added as null."""
    df = add_absent(df, key)
    return keep_first(df, joined_key(key), order)


def dedup_checksum(
    df: DataFrame, fields: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """First posting per concatenated text."""
    return keep_first(df, X.concat_fields(fields), order)


def dedup_stats(df: DataFrame, key: Column) -> DataFrame:
    """Rows before, rows after and rows dropped, in one aggregation.

    Groups are counted after a map-side combine, so no distinct state is gathered.
    """
    groups = df.groupBy(F.sha2(key, 256).alias("_key")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("dropped"),
    )


def observed_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with a row counter that fills when an action runs over it."""
    counter = Observation(name)
    return df.observe(counter, F.count(F.lit(1)).alias("rows")), counter


def missingness(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, one scan."""
    names = list(names or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in names])
    return wide.unpivot([], names, "column", "null_share")


def class_counts(df: DataFrame, label: str = "fraudulent") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))


def length_histogram(
    df: DataFrame, length: str, label: str, bins: int = C.LENGTH_BINS
) -> DataFrame:
    """Equal-width bins over the whole range of integer lengths, counted per label."""
    ends = df.agg(F.struct(F.min(length).alias("low"), F.max(length).alias("high"))).scalar()
    low, span = ends["low"], ends["high"] - ends["low"]
    offset = (F.col(length) - low).cast("long") * bins
    bin_no = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor(offset / F.greatest(span, F.lit(1))))
    )
    return df.groupBy(F.col(label).alias("label"), bin_no.cast("int").alias("bin")).agg(
        F.count("*").alias("rows")
    )


def align_columns(
    df: DataFrame, wanted: Mapping[str, object], *, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Exactly the wanted columns in order; absent or null ones take their default."""
    types = types or {}
    out = []
    for name, default in wanted.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        if name in types:
            c = c.cast(types[name])
        if default is not None:
            c = F.coalesce(c, F.lit(default))
        out.append(c.alias(name))
    return df.select(*out)


# Columns a scorer accepts, with the value that stands for an absent one.
SCORING_INPUT = {
    **{c: None for c in C.POSTING_COLUMNS if c not in ("job_id", "fraudulent", *C.FLAG_FIELDS)},
    **{c: 0 for c in C.FLAG_FIELDS},
}


def scoring_payload(df: DataFrame) -> DataFrame:
    """Rows as a scorer receives them: no label, no derived text, integer flags."""
    out = df.drop("fraudulent", "text_all")
    changes = {}
    for f in out.schema.fields:
        if f.name in C.FLAG_FIELDS:
            changes[f.name] = F.col(f.name).cast("double").cast("int")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changes[f.name] = F.nanvl(F.col(f.name), F.lit(None).cast("double"))
    return out.withColumns(changes) if changes else out
