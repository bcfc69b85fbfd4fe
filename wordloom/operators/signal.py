"""Operators on dense series ``(source, k, level)``: levels, backgrounds, onsets and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import islands


def smooth(frames: DataFrame, half: int = 2) -> DataFrame:
    """Centred moving average; what lies beyond the ends counts as zero."""
    w = Window.partitionBy("source").orderBy("k").rowsBetween(-half, half)
    return frames.withColumn("smooth", F.sum("level").over(w) / (2 * half + 1))


def background(frames: DataFrame, column: str = "level", share: float = 0.1) -> DataFrame:
    """The interpolated percentile of each source's values, null ones left out.

    Rounded once as ``fma(low, 1 - d, high * d)``, as DuckDB does: where levels are compared with a
    background plus a fixed step, equality is common and the last bit decides.
    """
    own = Window.partitionBy("source")
    at = (F.count(column).over(own) - 1) * F.lit(share)
    ranked = frames.select("source", F.col(column).cast("double").alias("_x"), at.alias("_at"), (F.row_number().over(own.orderBy(F.col(column).asc_nulls_last())) - 1).alias("_rank"))
    found = ranked.groupBy("source").agg(F.first("_at").alias("_at"), F.max(F.when(F.col("_rank") == F.floor("_at"), F.col("_x"))).alias("_low"), F.max(F.when(F.col("_rank") == F.ceil("_at"), F.col("_x"))).alias("_high"))
    d = F.col("_at") - F.floor("_at")
    between = F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"), F.col("_low"), 1 - d, F.col("_high") * d).cast("double")
    return found.select("source", F.when((d == 0) | F.col("_low").isNull(), F.col("_low")).otherwise(between).alias("background"))


def rolling_median(frames: DataFrame, width: int = 25, column: str = "level") -> DataFrame:
    w = Window.partitionBy("source").orderBy("k").rowsBetween(-(width - 1), 0)
    return frames.withColumn("median", F.percentile(column, 0.5).over(w))


def onsets(frames: DataFrame, rise: float, fall: float, most: int, width: int = 25, back: int = 3) -> DataFrame:
    """Transients: a jump over the rolling median that falls back within ``most`` frames.

    Rows ``source, k, k_end, peak, rise``: the onset, the first later frame within ``fall`` of the
    onset's background, the loudest level between and its height over that background.
    """
    f = rolling_median(frames, width)
    w = Window.partitionBy("source").orderBy("k")
    f = f.withColumn("_back", F.lag("level", back).over(w)).withColumn("_around", F.collect_list(F.struct("k", "level")).over(w.rowsBetween(0, most)))
    hit = f.where((F.col("k") >= back) & (F.col("level") - F.col("median") >= rise) & (F.col("level") - F.col("_back") >= rise / 2))
    quiet = F.filter("_around", lambda x: x["level"] <= F.col("median") + fall)
    hit = hit.withColumn("k_end", F.array_min(F.transform(quiet, lambda x: x["k"]))).where("k_end IS NOT NULL")
    peak = F.array_max(F.transform(F.filter("_around", lambda x: x["k"] < F.col("k_end")), lambda x: x["level"]))
    return hit.select("source", "k", "k_end", peak.alias("peak"), (peak - F.col("median")).alias("rise"))


def merge_events(events: DataFrame, at: str, least: int) -> DataFrame:
    """Events closer than ``least`` to the one before form a chain: first time, loudest peak, its rise."""
    e = events.withColumn("_last", islands.before(at, ["source"], [at]))
    e = islands.number(e, ["source"], [at], F.col(at) - F.col("_last") >= least)
    return e.groupBy("source", "island").agg(F.min(at).alias(at), F.max("peak").alias("peak"), F.max_by("rise", F.struct("peak", -F.col(at))).alias("rise"), F.count("*").alias("n")).drop("island")


def padded(spans: DataFrame, pad: int, least: int, top: DataFrame) -> DataFrame:
    """Spans of at least ``least``, padded, clamped to ``[0, duration]`` of ``top`` and united."""
    kept = spans.where(F.col("end") - F.col("start") >= least).join(top, "source")
    kept = kept.select("source", F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), F.least(F.col("end") + pad, F.col("duration")).alias("end")).where("end > start")
    return islands.union(kept, ["source"])


def snap(points: DataFrame, frames: DataFrame, reach: int) -> DataFrame:
    """The quietest frame within ``reach`` of each point (ties: nearest, then earlier), else the point.

    Equi-join on (source, bucket): a point meets the two or three buckets its reach touches.
    """
    p = points.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - reach) / (2 * reach + 1)), F.floor((F.col("at") + reach) / (2 * reach + 1)))))
    f = frames.select("source", "k", "level", F.floor(F.col("k") / (2 * reach + 1)).alias("_b"))
    met = p.join(f, ["source", "_b"], "left").withColumn("_near", F.abs(F.col("k") - F.col("at")) <= reach)
    best = F.min_by("k", F.when(F.col("_near"), F.struct("level", F.abs(F.col("k") - F.col("at")), "k")))
    return met.groupBy("source", "at").agg(F.coalesce(best, F.first("at")).alias("snapped"))
