"""Session set-up, checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(name: str = "siftline", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage and written tables: the one in `spark.checkpoint.dir`.

    Where that is unset, a local session gets a scratch folder; on a cluster it is an error, as
    executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftline-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_or_shuffle(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that `df` has at most `max_rows` rows.

    The count stops at `max_rows + 1`. A larger table is returned unhinted, so the
    join shuffles and AQE splits its skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffle_width(spark: SparkSession, low: int = 8, high: int = 512) -> int:
    """Number of buckets to cut a global order into: the shuffle width, bounded."""
    return max(low, min(high, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
