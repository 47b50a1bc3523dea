"""Event-time windows that read alike on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """The time column as a timestamp, with a watermark on streams."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late and df.isStreaming else out


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], *aggregates, late: str | None = "1 hour") -> DataFrame:
    """Aggregates by keys and windows of `width`; `bin` is the window's start."""
    return _timed(df, ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggregates).withColumn("bin", F.col("w.start").cast("timestamp_ntz")).drop("w")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates, late: str | None = "1 hour") -> DataFrame:
    """Aggregates by keys and sessions that end after a silence of `gap`."""
    out = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates)
    return out.withColumn("start", F.col("w.start").cast("timestamp_ntz")).withColumn("stop", F.col("w.end").cast("timestamp_ntz")).drop("w")


def latest(df: DataFrame, ts: str, keys: list[str], *columns: str) -> DataFrame:
    """The columns of the newest row of each key."""
    pick = F.max_by(F.struct(*columns), ts).alias("s")
    return _timed(df, ts, None).groupBy(*keys).agg(pick, F.max(ts).alias(ts)).select(*keys, ts, "s.*")
