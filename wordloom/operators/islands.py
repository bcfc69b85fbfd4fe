"""Gaps and islands, interval unions and running offsets on ordered relations.

All take the grouping columns and the order explicitly and leave partitioning on the grouping
columns, so several of them on one relation share a single shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Adds a running island number from 0; ``breaks`` is true where a row starts a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks, F.lit(False)).cast("long"))
    return df.withColumn("_break", flag).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def before(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def mask_spans(df: DataFrame, by: list[str], order: str, mask: str, length: int) -> DataFrame:
    """Maximal runs of true frames to spans ``start, end`` (frames are ``length`` long)."""
    runs = df.where(mask).withColumn("_run", F.col(order) - F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return runs.groupBy(*by, "_run").agg((F.min(order) * length).alias("start"), ((F.max(order) + 1) * length).alias("end")).drop("_run")


def bridge(spans: DataFrame, by: list[str], least: int) -> DataFrame:
    """Joins spans whose gap is under ``least`` (0 joins overlaps and, with ``touch``, contacts)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = number(spans.withColumn("_reach", reach), by, ["start", "end"], F.col("start") - F.col("_reach") >= least)
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def union(spans: DataFrame, by: list[str]) -> DataFrame:
    """Union of intervals; those that touch are joined."""
    return bridge(spans, by, 1)


def running_offset(df: DataFrame, by: list[str], order: list[str], size: str, name: str = "offset") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))
