"""Interval and as-of joins without a range-join operator.

``within`` cuts every interval into fixed-width buckets and joins on (keys, bucket), so Spark can
hash and, where one key is hot, split it; the residual predicate decides.  The as-of joins union
both sides and take a window, one shuffle for both and no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int, closed: bool = False) -> DataFrame:
    """Inner join of points with the intervals ``[start, end)`` (or ``[start, end]``) that hold them."""
    top = F.col(end) if closed else F.col(end) - 1
    cut = spans.where(F.col(end) >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(top / width), F.floor(F.col(start) / width)))))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    held = (F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end))
    return placed.join(cut, [*by, "_bucket"]).where((F.col(at) >= F.col(start)) & held).drop("_bucket")


def held(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, name: str, closed: bool = False) -> DataFrame:
    """``points`` with a column ``name``: whether any interval ``[start, end)`` (or ``[start, end]``) holds the point.

    Both stand in one window in order, in which the furthest end so far decides; where both already lie
    by ``by``, nothing is shuffled, and no interval is spread over its points.
    """
    place = spans.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(end).alias("_until"))
    both = points.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1)).unionByName(place, allowMissingColumns=True)
    until = F.max("_until").over(Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    inside = until >= F.col("_at") if closed else until > F.col("_at")
    return both.withColumn(name, F.coalesce(inside, F.lit(False))).where("_side = 1").select(*points.columns, name)


def next_at_or_after(points: DataFrame, marks: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """For each point the smallest ``value`` of ``marks`` with ``mark >= at`` (columns ``by, mark, value``)."""
    return _nearest(points, marks, by, at, value, name, forward=True)


def last_at_or_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    return _nearest(points, marks, by, at, value, name, forward=False)


def _nearest(points: DataFrame, marks: DataFrame, by: list[str], at: str, value: str, name: str, forward: bool) -> DataFrame:
    columns = [c for c in points.columns if c not in by]
    left = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("_value"), F.struct(*columns).alias("_row"))
    right = marks.select(*by, F.col("mark").alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*by).orderBy(F.col("_at").desc() if forward else F.col("_at"), "_side", F.col("_value").desc() if forward else F.col("_value"))
    found = F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = left.unionByName(right).withColumn(name, found).where("_side = 1")
    return out.select(*by, *[F.col(f"_row.{c}").alias(c) for c in columns], name)
