"""Word, frame and point relations made from the driver's tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import islands

GAP_MS, STEP_MS, WORD_MS = 400, 400, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_BYTES = 4_000_000  #: of a table's files, of which one task cuts the texts to words


def placed(texts: DataFrame, key: str) -> DataFrame:
    """``texts`` dealt by ``key`` before they are cut to words.

    What follows by that key (sentences, windows, ranges) needs no further shuffle, the texts travel
    once instead of their words, and a task's share does not grow with the table.
    """
    spark = texts.sparkSession
    files = int(texts._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes())  # a projection's own figure is a guess
    return texts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files // PART_BYTES)), key)


def tokens(docs: DataFrame) -> DataFrame:
    """``source, i, w``: the white-space tokens of every document."""
    every = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return placed(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("source"), F.posexplode(every).alias("i", "w"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, i, w, norm, ends, sent, start, end`` (ms); a sentence end is followed by a pause."""
    w = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    made = tokens(table(spark, sf_dir, "documents")).withColumn("ends", T.ends_sentence(F.col("w")))
    made = made.withColumn("sent", F.coalesce(F.sum(F.col("ends").cast("long")).over(w), F.lit(0)))
    start = F.col("i").cast("long") * STEP_MS + 700 * F.col("sent")
    return made.select("source", "i", "w", T.normal(F.col("w")).alias("norm"), "ends", "sent", start.alias("start"), (start + WORD_MS).alias("end"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, k, level, event_type, ts``: one user's events in time order as a dense series."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), (F.row_number().over(order) - 1).cast("long").alias("k"), F.col("value").alias("level"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))


def sessions(spark: SparkSession, sf_dir: str, gap_ms: int = 43_200_000) -> DataFrame:
    """``source, session, start, end`` of one user's events with no pause over 12 hours."""
    f = frames(spark, sf_dir)
    f = f.withColumn("_last", islands.before("ts", ["source"], ["k"]))
    f = islands.number(f, ["source"], ["k"], F.col("ts") - F.col("_last") > gap_ms, "session")
    return f.groupBy("source", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


WORDS_SQL = """
tok AS (SELECT source, ws[i + 1] AS w, i FROM (SELECT source, ws, unnest(range(len(ws))) AS i FROM (
  SELECT doc_id AS source, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS ws FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''))),
tok2 AS (SELECT *, regexp_matches(w, '[.?!]$') AS ends, regexp_replace(lower(w), '\\p{P}', '', 'g') AS norm FROM tok),
tok3 AS (SELECT *, CAST(coalesce(sum(CAST(ends AS BIGINT)) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent FROM tok2),
words AS (SELECT source, i, w, norm, ends, sent, i * 400 + 700 * sent AS "start", i * 400 + 700 * sent + 300 AS "end" FROM tok3)"""
FRAMES_SQL = """
frames AS (SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value AS level, event_type, epoch_us(ts) // 1000 AS ts FROM events)"""
SESSIONS_SQL = FRAMES_SQL + """,
s1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY k) > 43200000 THEN 1 ELSE 0 END AS b FROM frames),
s2 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS session FROM s1),
sessions AS (SELECT source, CAST(session AS BIGINT) AS session, min(ts) AS "start", max(ts) AS "end" FROM s2 GROUP BY source, session)"""
