"""Streaming forms of the episode operators: sessions of a user's events, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Episodes of events no further apart than ``gap``: start_time, end_time, n_events.

    Works on streams and tables alike. On a stream an episode is emitted once the watermark has passed its end; events
    later than ``late`` are left out. A time without a zone is taken as UTC, for a watermark needs one.
    """
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = d.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("last"))
    return g.select(*keys, F.col("w.start").alias("start_time"), F.col("last").alias("end_time"), "n_events")
