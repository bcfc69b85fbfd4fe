"""Spans of a live series: the engine's gap sessions and zones on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans(points: DataFrame, gap: str = "12 hours", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """``source, start, end, n`` of points ``source, ts`` with no pause over ``gap``.

    A span is final once the watermark (``late`` behind the newest point) passes its end plus the
    gap; points older than the watermark are left out.  State is one row an open span.  On a table
    instead of a stream it gives the same spans, all of them.
    """
    marked = points.withWatermark(at, late)
    made = marked.groupBy("source", F.session_window(at, gap)).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return made.select("source", "start", "end", "n")


def levels(points: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "ts", value: str = "value") -> DataFrame:
    """``source, start, rms, n`` of tumbling windows: the live form of the resampled energy series."""
    marked = points.withWatermark(at, late)
    made = marked.groupBy("source", F.window(at, width)).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n"))
    return made.select("source", F.col("window.start").alias("start"), "rms", "n")
