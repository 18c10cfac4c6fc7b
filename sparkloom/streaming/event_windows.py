"""Event-time windows that run alike over batch tables and streams. An extension: the same plan takes readStream sources,
with a watermark that bounds the state; a batch ignores it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.aggregate import measure


def _late(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    """With a watermark on streams, whose event time must be an instant."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark) if watermark and df.isStreaming else df


def windowed(df: DataFrame, time: str, width: str, measures: Sequence[tuple[str, str, str]], keys: Sequence[str] = (), slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``: window_start, the keys and the measures."""
    held = _late(df, time, watermark)
    grouped = held.groupBy(F.window(time, width, slide or width).alias("__w"), *keys).agg(*[measure(held, c, how).alias(n) for c, how, n in measures])
    return grouped.select(F.col("__w.start").alias("window_start"), *keys, *[n for _, _, n in measures])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], measures: Sequence[tuple[str, str, str]], watermark: str | None = "1 hour") -> DataFrame:
    """Sessions that end after a gap without events: session_start, session_end, the keys and the measures."""
    held = _late(df, time, watermark)
    grouped = held.groupBy(F.session_window(time, gap).alias("__w"), *keys).agg(*[measure(held, c, how).alias(n) for c, how, n in measures])
    return grouped.select(F.col("__w.start").alias("session_start"), F.col("__w.end").alias("session_end"), *keys, *[n for _, _, n in measures])
