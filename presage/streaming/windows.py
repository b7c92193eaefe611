"""Event-time windows; each function takes a streaming or a static frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay) if events.isStreaming else events


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, delay: str = "1 hour") -> DataFrame:
    """(keys..., start, n) per window of a fixed width."""
    out = _late(events, ts, delay).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, ts: str, keys: list[str], width: str, step: str, delay: str = "1 hour") -> DataFrame:
    out = _late(events, ts, delay).groupBy(*keys, F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """(keys..., start, n) per session that ends after a gap."""
    out = _late(events, ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key's rows once."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
