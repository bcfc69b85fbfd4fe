"""Labels against predictions: confusion metrics, rates and the delta report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """One row of metrics from ``predicted, gold, unit`` (booleans and the unit a false cut counts in)."""
    n = lambda cond: F.count_if(cond)
    agg = rows.agg(
        n(F.col("predicted") & F.col("gold")).alias("both"), n(F.col("predicted")).alias("kept"), n(F.col("gold")).alias("gold_kept"),
        F.count_distinct(F.when(F.col("gold") & ~F.col("predicted"), F.col("unit"))).alias("false_cut_units"), n(F.col("predicted") & ~F.col("gold")).alias("missed"),
    )
    precision = F.when(F.col("kept") > 0, F.col("both") / F.col("kept")).when(F.col("gold_kept") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("gold_kept") > 0, F.col("both") / F.col("gold_kept")).otherwise(1.0)
    out = agg.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).drop("both")


def delta(now: DataFrame, previous: DataFrame, fields: list[str]) -> DataFrame:
    """``metric, current, previous, delta`` of two one-row metric relations."""
    long = lambda df: df.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot([], fields, "metric", "value")
    a, b = long(now).withColumnRenamed("value", "current"), long(previous).withColumnRenamed("value", "previous")
    return a.join(b, "metric").withColumn("delta", F.col("current") - F.col("previous"))
