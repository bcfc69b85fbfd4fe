"""All queries on the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timing
from ..operators import fillers, intervals, islands, repeats, scoring, signal, timeline
from .carriers import FRAMES_SQL, SESSIONS_SQL, WORDS_SQL, frames, placed, sessions, table, words
from .registry import query

GROUP_SQL = """g1 AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY source ORDER BY i) > 400 THEN 1 ELSE 0 END AS b FROM words),
g2 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS range_no FROM g1),
ranges AS (SELECT source, CAST(range_no AS BIGINT) AS range_no, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, CAST(min("start") AS BIGINT) AS in_ms, CAST(max("end") AS BIGINT) AS out_ms, count(*) AS n_words FROM g2 GROUP BY source, range_no)"""


def _ranges(spark, sf_dir):
    return timeline.group(words(spark, sf_dir)).select("source", F.col("range_no"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "in_ms", "out_ms", "n_words")


@query(f"WITH {WORDS_SQL}, {GROUP_SQL} SELECT * FROM ranges")
def range_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


@query(f"WITH {WORDS_SQL} SELECT norm, count(*) AS n, count(DISTINCT source) AS n_sources FROM words GROUP BY norm")
def word_normalize(spark, sf_dir):
    return words(spark, sf_dir).groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@query(f'WITH {WORDS_SQL} SELECT source, sent, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, CAST(min("start") AS BIGINT) AS start_ms, CAST(max("end") AS BIGINT) AS end_ms FROM words GROUP BY source, sent')
def sentence_index(spark, sf_dir):
    return words(spark, sf_dir).groupBy("source", "sent").agg(F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word"), F.min("start").alias("start_ms"), F.max("end").alias("end_ms"))


@query("""WITH c AS (SELECT doc_id AS source, unnest(range(1, len(text) + 1)) AS k, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT source, (k - 1) // 4 AS piece, string_agg(substr(text, k, 1), '' ORDER BY k) AS tok FROM c GROUP BY source, (k - 1) // 4),
g AS (SELECT *, sum(CASE WHEN tok LIKE ' %' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY piece ROWS UNBOUNDED PRECEDING) AS w FROM p)
SELECT source, CAST(w AS BIGINT) AS word, string_agg(tok, '' ORDER BY piece) AS w, CAST(min(piece) AS BIGINT) AS first_piece, CAST(max(piece) AS BIGINT) AS last_piece FROM g GROUP BY source, w""")
def subword_merge(spark, sf_dir):
    """Pieces of four characters stand for sub-words; one that begins with a space starts a word."""
    pieces = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("text <> ''").select(F.col("doc_id").alias("source"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,4}"), F.lit(0))).alias("piece", "tok"))
    w = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    made = pieces.withColumn("word", F.sum(F.col("tok").startswith(" ").cast("long")).over(w))
    return made.groupBy("source", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "tok"))), lambda x: x["tok"]), "").alias("w"), F.min("piece").cast("long").alias("first_piece"), F.max("piece").cast("long").alias("last_piece"))


@query(f"""WITH {FRAMES_SQL} SELECT source, k, ts, CAST(max(ts - CAST(floor(level) AS BIGINT) * 1000) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS repaired FROM frames""")
def timestamp_repair(spark, sf_dir):
    """Jittered times made non-decreasing by the running maximum."""
    w = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return frames(spark, sf_dir).select("source", "k", "ts", F.max(F.col("ts") - F.floor("level").cast("long") * 1000).over(w).alias("repaired"))


@query(f"WITH {FRAMES_SQL} SELECT source, k, round(sum(level) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM frames")
def smooth_level(spark, sf_dir):
    return signal.smooth(frames(spark, sf_dir)).select("source", "k", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {FRAMES_SQL} SELECT source, round(quantile_cont(level, 0.1), 6) AS background FROM frames GROUP BY source")
def background_p10(spark, sf_dir):
    return signal.background(frames(spark, sf_dir)).select("source", F.round("background", 6).alias("background"))


@query(f"WITH {FRAMES_SQL} SELECT source, k, round(median(level) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS median FROM frames")
def rolling_median(spark, sf_dir):
    return signal.rolling_median(frames(spark, sf_dir)).select("source", "k", F.round("median", 6).alias("median"))


ONSETS_SQL = FRAMES_SQL + """,
o1 AS (SELECT *, median(level) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS med, lag(level, 3) OVER (PARTITION BY source ORDER BY k) AS bk FROM frames),
o2 AS (SELECT * FROM o1 WHERE k >= 3 AND level - med >= 20 AND level - bk >= 10),
o3 AS (SELECT o2.source, o2.k, o2.med, min(f.k) AS k_end FROM o2 JOIN frames f ON f.source = o2.source AND f.k BETWEEN o2.k AND o2.k + 8 AND f.level <= o2.med + 6 GROUP BY o2.source, o2.k, o2.med),
onsets AS (SELECT o3.source, o3.k, o3.k_end, max(f.level) AS peak, max(f.level) - o3.med AS rise FROM o3 JOIN frames f ON f.source = o3.source AND f.k >= o3.k AND f.k < o3.k_end GROUP BY o3.source, o3.k, o3.k_end, o3.med)"""


def _onsets(spark, sf_dir):
    return signal.onsets(frames(spark, sf_dir), 20.0, 6.0, 8)


@query(f"WITH {ONSETS_SQL} SELECT source, k, k_end, round(peak, 6) AS peak, round(rise, 6) AS rise FROM onsets")
def onset_detect(spark, sf_dir):
    return _onsets(spark, sf_dir).select("source", "k", "k_end", F.round("peak", 6).alias("peak"), F.round("rise", 6).alias("rise"))


@query(f"""WITH {ONSETS_SQL}, m1 AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY source ORDER BY k) >= 4 THEN 1 ELSE 0 END AS b FROM onsets),
m2 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM m1)
SELECT source, min(k) AS k, round(max(peak), 6) AS peak, round(arg_max(rise, (peak, -k)), 6) AS rise, count(*) AS n FROM m2 GROUP BY source, g""")
def onset_merge(spark, sf_dir):
    return signal.merge_events(_onsets(spark, sf_dir), "k", 4).select("source", "k", F.round("peak", 6).alias("peak"), F.round("rise", 6).alias("rise"), "n")


MASK_SQL = FRAMES_SQL + """,
sm AS (SELECT source, k, sum(level) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM frames),
bg AS (SELECT source, quantile_cont(s, 0.1) AS b FROM sm GROUP BY source),
mk AS (SELECT sm.source, k FROM sm JOIN bg ON sm.source = bg.source WHERE s >= b + 20),
sp AS (SELECT source, k, k - row_number() OVER (PARTITION BY source ORDER BY k) AS g FROM mk),
spans AS (SELECT source, min(k) * 10 AS "start", (max(k) + 1) * 10 AS "end" FROM sp GROUP BY source, g)"""


def _spans(spark, sf_dir):
    f = signal.smooth(frames(spark, sf_dir), 1)
    b = signal.background(f, "smooth").select("source", F.col("background").alias("b"))
    return islands.mask_spans(f.join(b, "source").withColumn("voiced", F.col("smooth") >= F.col("b") + 20), ["source"], "k", "voiced", 10)


@query(f'WITH {MASK_SQL} SELECT source, "start", "end" FROM spans')
def mask_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(f"""WITH {MASK_SQL}, b1 AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY source ORDER BY "start") >= 15 THEN 1 ELSE 0 END AS b FROM spans),
b2 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS g FROM b1), b3 AS (SELECT source, min("start") AS s, max("end") AS e FROM b2 GROUP BY source, g),
d AS (SELECT source, (max(k) + 1) * 10 AS dur FROM frames GROUP BY source), p AS (SELECT b3.source, greatest(s - 8, 0) AS s, least(e + 8, dur) AS e FROM b3 JOIN d ON d.source = b3.source WHERE e - s >= 20),
u1 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM p WHERE e > s),
u2 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM u1) SELECT source, min(s) AS "start", max(e) AS "end" FROM u2 GROUP BY source, g""")
def bridge_pad_union(spark, sf_dir):
    top = frames(spark, sf_dir).groupBy("source").agg(((F.max("k") + 1) * 10).alias("duration"))
    return signal.padded(islands.bridge(_spans(spark, sf_dir), ["source"], 15), 8, 20, top)


@query(f"""WITH {MASK_SQL}, t AS (SELECT source, sum("end" - "start") AS voiced FROM spans GROUP BY source), d AS (SELECT source, count(*) * 10 AS total FROM frames GROUP BY source)
SELECT d.source, round(coalesce(voiced, 0) / total, 6) AS share FROM d LEFT JOIN t ON t.source = d.source""")
def speech_share(spark, sf_dir):
    total = frames(spark, sf_dir).groupBy("source").agg((F.count("*") * 10).alias("total"))
    voiced = _spans(spark, sf_dir).groupBy("source").agg(F.sum(F.col("end") - F.col("start")).alias("voiced"))
    return total.join(voiced, "source", "left").select("source", F.round(F.coalesce("voiced", F.lit(0)) / F.col("total"), 6).alias("share"))


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT source, k AS a FROM frames WHERE event_type = 'error'),
c AS (SELECT p.source, p.a, f.k, row_number() OVER (PARTITION BY p.source, p.a ORDER BY f.level, abs(f.k - p.a), f.k) AS r FROM p JOIN frames f ON f.source = p.source AND f.k BETWEEN p.a - 5 AND p.a + 5)
SELECT source, a AS "at", k AS snapped FROM c WHERE r = 1""")
def snap_min(spark, sf_dir):
    f = frames(spark, sf_dir)
    return signal.snap(f.where("event_type = 'error'").select("source", F.col("k").alias("at")), f, 5)


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS n FROM frames WHERE event_type = 'purchase'), e AS (SELECT source, k FROM frames WHERE event_type = 'error')
SELECT e.source, e.k, (SELECT min(p.k) FROM p WHERE p.source = e.source AND p.k >= e.k) AS next_k FROM e""")
def clap_anchor_asof(spark, sf_dir):
    f = frames(spark, sf_dir)
    marks = f.where("event_type = 'purchase'").select("source", F.col("k").alias("mark"), F.col("k").alias("value"))
    return intervals.next_at_or_after(f.where("event_type = 'error'").select("source", "k"), marks, ["source"], "k", "value", "next_k")


@query(f"""WITH {SESSIONS_SQL} SELECT f.source, f.k, s.session FROM frames f JOIN sessions s ON s.source = f.source AND f.ts >= s."start" AND f.ts <= s."end" WHERE f.event_type = 'click'""")
def segment_at(spark, sf_dir):
    clicks = frames(spark, sf_dir).where("event_type = 'click'").select("source", "k", "ts")
    return intervals.within(clicks, sessions(spark, sf_dir), ["source"], "ts", "start", "end", 86_400_000, closed=True).select("source", "k", "session")


@query(f"""WITH {SESSIONS_SQL}, x AS (SELECT s.source, s.session, (count(f.k) FILTER (f.event_type = 'purchase')) > 0 AS hit FROM sessions s LEFT JOIN frames f ON f.source = s.source AND f.ts >= s."start" AND f.ts <= s."end" GROUP BY s.source, s.session)
SELECT source, session FROM x WHERE NOT hit""")
def unheard(spark, sf_dir):
    """Sessions without a purchase: an anti interval join."""
    s = sessions(spark, sf_dir)
    buys = frames(spark, sf_dir).where("event_type = 'purchase'").select("source", "ts")
    met = intervals.within(buys, s, ["source"], "ts", "start", "end", 86_400_000, closed=True).select("source", "session").distinct()
    return s.join(met, ["source", "session"], "left_anti").select("source", "session")


@query(f"""WITH {SESSIONS_SQL}, z AS (SELECT source, ts - 3600000 AS zs, ts + 3600000 AS ze FROM frames WHERE event_type = 'error')
SELECT s.source, s.session, count(*) AS n_zones FROM sessions s JOIN z ON z.source = s.source AND s."start" < z.ze AND z.zs < s."end" GROUP BY s.source, s.session""")
def zone_hits(spark, sf_dir):
    """Sessions that overlap a zone about an error, by bucketed equi-join on both intervals."""
    width = 86_400_000
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    z = frames(spark, sf_dir).where("event_type = 'error'").select("source", F.col("k").alias("zone"), (F.col("ts") - 3_600_000).alias("zs"), (F.col("ts") + 3_600_000).alias("ze")).withColumn("b", buckets("zs", "ze"))
    s = sessions(spark, sf_dir).withColumn("b", buckets("start", "end"))
    met = s.join(z, ["source", "b"]).where("start < ze AND zs < end")
    return met.select("source", "session", "zone").distinct().groupBy("source", "session").agg(F.count("*").alias("n_zones"))


@query(f"""WITH {WORDS_SQL} SELECT source, i, lag("end") OVER w AS end_before, lead("start") OVER w AS start_after FROM words WINDOW w AS (PARTITION BY source ORDER BY i)""")
def neighbours(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("i")
    return words(spark, sf_dir).select("source", F.col("i").cast("long").alias("i"), F.lag("end").over(w).alias("end_before"), F.lead("start").over(w).alias("start_after"))


CUT_SQL = f"""WITH {WORDS_SQL}, {GROUP_SQL},
nb AS (SELECT source, i, lag("end") OVER w AS bf, lead("start") OVER w AS af FROM words WINDOW w AS (PARTITION BY source ORDER BY i)),
cuts AS (SELECT r.source, r.range_no, r.first_word, r.last_word, CAST(greatest(in_ms - 80, coalesce(a.bf, 0)) AS BIGINT) AS cut_in, CAST(least(out_ms + 120, coalesce(b.af, out_ms + 120)) AS BIGINT) AS cut_out
  FROM ranges r JOIN nb a ON a.source = r.source AND a.i = r.first_word JOIN nb b ON b.source = r.source AND b.i = r.last_word),
fr AS (SELECT *, (cut_in * 30000) // 1001000 AS in_frame, (cut_out * 30000 + 1000999) // 1001000 AS of0 FROM cuts),
framed AS (SELECT source, range_no, first_word, last_word, cut_in, cut_out, in_frame, CASE WHEN of0 <= in_frame THEN in_frame + 1 ELSE of0 END AS out_frame FROM fr)"""


def _framed(spark, sf_dir):
    return timeline.framed(timeline.cut_ranges(words(spark, sf_dir)), 30000, 1001)


@query(CUT_SQL + " SELECT * FROM framed")
def frame_round(spark, sf_dir):
    return _framed(spark, sf_dir)


@query(CUT_SQL + """, m1 AS (SELECT *, CASE WHEN in_frame - lag(out_frame) OVER (PARTITION BY source ORDER BY in_frame) > 12 THEN 1 ELSE 0 END AS b FROM framed),
m2 AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY in_frame ROWS UNBOUNDED PRECEDING) AS piece FROM m1)
SELECT source, CAST(piece AS BIGINT) AS piece, min(first_word) AS first_word, max(last_word) AS last_word, min(in_frame) AS in_frame, max(out_frame) AS out_frame, count(*) AS merged FROM m2 GROUP BY source, piece""")
def merge_touching(spark, sf_dir):
    return timeline.merge_touching(_framed(spark, sf_dir), 12)


@query(CUT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY in_frame) AS k, first_word AS fw, last_word AS lw, in_frame AS f0, out_frame AS f1, lead(in_frame) OVER (PARTITION BY source ORDER BY in_frame) AS nx FROM framed),
g AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS dn, CAST(NULL AS BIGINT) AS dfw, CAST(NULL AS BIGINT) AS dlw, CAST(NULL AS BIGINT) AS d0, CAST(NULL AS BIGINT) AS d1, CAST(NULL AS BIGINT) AS cfw, CAST(NULL AS BIGINT) AS c0 FROM o UNION ALL
SELECT source, k, CASE WHEN big THEN dn + 1 ELSE dn END, CASE WHEN big THEN fw ELSE dfw END, CASE WHEN big OR back THEN lw ELSE dlw END, CASE WHEN big THEN f0 ELSE d0 END, CASE WHEN big OR back THEN f1 ELSE d1 END, CASE WHEN NOT big AND NOT back AND nx - f1 <= 20 THEN fw END, CASE WHEN NOT big AND NOT back AND nx - f1 <= 20 THEN f0 END
FROM (SELECT g.source, o.k, g.dn, g.dfw, g.dlw, g.d0, g.d1, coalesce(g.cfw, o.fw) AS fw, o.lw, coalesce(g.c0, o.f0) AS f0, o.f1, o.nx, o.f1 - coalesce(g.c0, o.f0) >= 15 AS big, coalesce(o.f1 - coalesce(g.c0, o.f0) < 15 AND g.dn > 0 AND coalesce(g.c0, o.f0) - g.d1 <= 20, false) AS back FROM g JOIN o ON o.source = g.source AND o.k = g.k + 1))
SELECT source, arg_max(dfw, k) AS first_word, arg_max(dlw, k) AS last_word, arg_max(d0, k) AS in_frame, arg_max(d1, k) AS out_frame FROM g WHERE dn > 0 GROUP BY source, dn""")
def remove_tiny(spark, sf_dir):
    return timeline.remove_tiny(_framed(spark, sf_dir), 15, 20)


@query(CUT_SQL + """, o AS (SELECT source, range_no, in_frame, out_frame, out_frame - in_frame AS frames FROM framed)
SELECT source, range_no, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY source ORDER BY range_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM o""")
def running_offset(spark, sf_dir):
    r = _framed(spark, sf_dir).withColumn("frames", F.col("out_frame") - F.col("in_frame"))
    return islands.running_offset(r, ["source"], ["range_no"], "frames").select("source", "range_no", "frames", "offset")


@query(CUT_SQL + """, mk AS (SELECT source, CAST(i AS BIGINT) AS at_word, "start" FROM words WHERE norm = 'the')
SELECT mk.source, mk.at_word, f.range_no, least(greatest((mk."start" * 30000) // 1001000, f.in_frame), f.out_frame - 1) AS at_frame FROM mk JOIN framed f ON f.source = mk.source AND mk.at_word BETWEEN f.first_word AND f.last_word""")
def marker_frame(spark, sf_dir):
    """A marker on every ``the``: the frame of its word, clamped into the range that holds it."""
    marks = words(spark, sf_dir).where("norm = 'the'").select("source", F.col("i").cast("long").alias("at_word"), "start")
    met = timeline.attach(marks, _framed(spark, sf_dir), ("in_frame", "out_frame"))
    return met.select("source", "at_word", "range_no", timing.clamp(timing.first_frame(F.col("start"), F.lit(30000), F.lit(1001)), F.col("in_frame"), F.col("out_frame") - 1).alias("at_frame"))


@query(f"""WITH {WORDS_SQL}, {GROUP_SQL}, r AS (SELECT * FROM ranges WHERE n_words >= 8), mk AS (SELECT DISTINCT source, CAST(i AS BIGINT) AS at_word FROM words WHERE ends)
SELECT mk.source, mk.at_word, coalesce((SELECT min(r.range_no) FROM r WHERE r.source = mk.source AND r.last_word >= mk.at_word), (SELECT max(r.range_no) FROM r WHERE r.source = mk.source)) AS range_no FROM mk""")
def marker_attach(spark, sf_dir):
    """Sentence ends to the long range that holds them, else the next long one, else the last."""
    marks = words(spark, sf_dir).where("ends").select("source", F.col("i").cast("long").alias("at_word"))
    return timeline.attach(marks, _ranges(spark, sf_dir).where("n_words >= 8"))


@query(f"""WITH {WORDS_SQL}, sd AS (SELECT source, CAST(min(i) AS BIGINT) AS a, CAST(max(i) AS BIGINT) AS b, count(*) AS n FROM words GROUP BY source, sent)
SELECT w.source, count(*) AS kept, CAST(sum(CASE WHEN w.ends THEN 1 ELSE 0 END) AS BIGINT) AS kept_ends FROM words w WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.n = 2 AND sd.source = w.source AND w.i BETWEEN sd.a AND sd.b) GROUP BY w.source""")
def kept_anti_join(spark, sf_dir):
    w = words(spark, sf_dir)
    gone = w.groupBy("source", "sent").agg(F.min("i").alias("first_word"), F.max("i").alias("last_word"), F.count("*").alias("n")).where("n = 2")
    return fillers.kept(w, gone).groupBy("source").agg(F.count("*").alias("kept"), F.sum(F.col("ends").cast("long")).alias("kept_ends"))


LISTED = "('er', 'the', 'de', 'la', 'ah', 'um')"


@query(f"""WITH {WORDS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS rn, norm IN {LISTED} AND count(*) OVER (PARTITION BY source, sent) > 1 AS fl FROM words),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY source ORDER BY i) AS g FROM f WHERE fl)
SELECT source, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, count(*) AS n, CAST(max("end") - min("start") AS BIGINT) AS duration_ms, CASE WHEN max("end") - min("start") > 1500 THEN 'keep' ELSE 'drop' END AS action FROM g GROUP BY source, g""")
def filler_runs(spark, sf_dir):
    found = fillers.runs(words(spark, sf_dir), ["er", "the", "de", "la", "ah", "um"])
    return found.withColumn("first_word", F.col("first_word").cast("long")).withColumn("last_word", F.col("last_word").cast("long"))


# no word of these phrases but the last is listed, so that phrases and runs overlap only in a run's first word
@query(f"""WITH {WORDS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS rn, count(*) OVER (PARTITION BY source, sent) > 1 AS free FROM words),
p AS (SELECT *, coalesce(free AND norm IN ('of', 'to') AND lead(norm) OVER q = 'the' AND lead(free) OVER q, false) AS ph, lead("end") OVER q AS e2 FROM f WINDOW q AS (PARTITION BY source ORDER BY i)),
c AS (SELECT *, free AND norm IN {LISTED} AND NOT coalesce(lag(ph) OVER (PARTITION BY source ORDER BY i), false) AS fl FROM p),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY source ORDER BY i) AS g FROM c WHERE fl),
u AS (SELECT source, min(i) AS first_word, max(i) AS last_word, 'run' AS kind, max("end") - min("start") AS d FROM g GROUP BY source, g
  UNION ALL SELECT source, i, i + 1, 'phrase', e2 - "start" FROM p WHERE ph)
SELECT source, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, kind, CAST(d AS BIGINT) AS duration_ms, CASE WHEN d > 1500 THEN 'keep' ELSE 'drop' END AS action FROM u""")
def filler_spans(spark, sf_dir):
    found = fillers.spans(words(spark, sf_dir), ["er", "the", "de", "la", "ah", "um"], [["of", "the"], ["to", "the"]])
    return found.withColumn("first_word", F.col("first_word").cast("long")).withColumn("last_word", F.col("last_word").cast("long"))


@query(f"""WITH {WORDS_SQL}, x AS (SELECT *, bool_and(norm IN ('um', 'uh', 'uhm', 'umm', 'erm', 'hmm', 'mhm', 'mm', 'ah', 'eh', 'er')) OVER (PARTITION BY source, sent ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clear,
lead(i) OVER (PARTITION BY source, sent ORDER BY i) AS nx FROM words) SELECT source, sent, CAST(i AS BIGINT) AS i, norm FROM x WHERE coalesce(clear, true) AND nx IS NOT NULL AND norm IN ('the', 'and', 'la', 'der')""")
def filler_openers(spark, sf_dir):
    return fillers.openers(words(spark, sf_dir), ["the", "and", "la", "der"]).withColumn("i", F.col("i").cast("long"))


@query(f"""WITH {WORDS_SQL}, x AS (SELECT source, i, norm, lead(norm) OVER (PARTITION BY source ORDER BY i) AS n1 FROM words) SELECT source, CAST(i AS BIGINT) AS first_word, CAST(i + 1 AS BIGINT) AS last_word FROM x WHERE norm = 'of' AND n1 = 'the'""")
def phrase_match(spark, sf_dir):
    return fillers.phrases(words(spark, sf_dir), ["of", "the"]).select("source", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``conversations``: project = conversation, source = turn, i over the whole conversation."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    turns = placed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id").where(text != "").select(F.col("conv_id").alias("project"), F.col("turn").alias("source"), F.posexplode(F.split(text, r"\s+")).alias("pos", "w"))
    order = Window.partitionBy("project").orderBy("source", "pos")
    made = turns.withColumn("i", (F.row_number().over(order) - 1).cast("long")).withColumn("ends", T.ends_sentence(F.col("w")))
    return made.select("project", "source", "i", "w", T.normal(F.col("w")).alias("norm"), "ends", (F.col("i") * 400).alias("start"), (F.col("i") * 400 + 300).alias("end"))


TALK_SQL = """
tt AS (SELECT project, source, p, ws[p + 1] AS w FROM (SELECT project, source, ws, unnest(range(len(ws))) AS p FROM (SELECT conv_id AS project, turn AS source, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS ws FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''))),
talk AS (SELECT project, source, row_number() OVER (PARTITION BY project ORDER BY source, p) - 1 AS i, w, regexp_replace(lower(w), '\\p{P}', '', 'g') AS norm FROM tt)"""


STOP_SQL = "['" + "', '".join(T.STOPWORDS) + "']"
RUNS_SQL = TALK_SQL + """,
r AS (SELECT project, source, i, list(norm) OVER (PARTITION BY project, source ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM talk)"""
# pairs of runs ``met(i, j, ra, rb, n)`` to their accepted matches
MATCH_SQL = f"""
sm AS (SELECT *, list_transform(range(1, n + 1), lambda t: ra[t] = rb[t]) AS same FROM met),
wr AS (SELECT *, list_filter(range(1, n + 1), lambda t: NOT same[t]) AS wrong FROM sm),
ct AS (SELECT *, coalesce(list_min(list_filter(wrong, lambda t: t = n OR NOT same[t + 1] OR list_position(wrong, t) > 5)) - 1, n) AS cut FROM wr),
mt AS (SELECT *, len(list_filter(range(1, cut + 1), lambda t: same[t])) AS matches, len(list_filter(range(1, cut + 1), lambda t: same[t] AND ra[t] <> '' AND NOT list_contains({STOP_SQL}, ra[t]))) AS content FROM ct)"""
CANDIDATES_SQL = RUNS_SQL + """,
met AS (SELECT a.project, a.source, b.i, a.i AS j, a.run AS ra, b.run AS rb, least(len(a.run), len(b.run), b.i - a.i) AS n FROM r a JOIN r b ON a.project = b.project AND a.source = b.source AND a.i < b.i AND (b.i - a.i) * 400 <= 90000
  AND (a.run[1] = b.run[1] OR (len(a.run) > 1 AND len(b.run) > 1 AND a.run[2] = b.run[2]))),""" + MATCH_SQL + """,
cand AS (SELECT project, source, i, max(j) AS j, CAST(arg_max(matches, j) AS BIGINT) AS matches, CAST(arg_max(cut - matches, j) AS BIGINT) AS mismatches FROM mt WHERE matches >= 3 AND (matches >= 5 OR content > 0) GROUP BY project, source, i)"""


@query(f"WITH {CANDIDATES_SQL} SELECT * FROM cand")
def repeat_candidates(spark, sf_dir):
    found = repeats.candidates(talk(spark, sf_dir))
    return found.withColumn("matches", F.col("matches").cast("long")).withColumn("mismatches", F.col("mismatches").cast("long"))


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, cn AS (SELECT *, row_number() OVER (PARTITION BY project, source ORDER BY i) AS k FROM cand),
g AS (SELECT project, source, k, i, j, matches, mismatches, true AS stays, i AS free, 1 AS n FROM cn WHERE k = 1 UNION ALL
SELECT cn.project, cn.source, cn.k, cn.i, cn.j, cn.matches, cn.mismatches, cn.j >= g.free, CASE WHEN cn.j >= g.free THEN cn.i ELSE g.free END, g.n + CASE WHEN cn.j >= g.free THEN 1 ELSE 0 END FROM g JOIN cn ON cn.project = g.project AND cn.source = g.source AND cn.k = g.k + 1)
SELECT project, source, i, j, matches, mismatches, 'd' || lpad(CAST(n AS VARCHAR), 3, '0') AS id FROM g WHERE stays""")
def repeat_claims(spark, sf_dir):
    found = repeats.candidates(talk(spark, sf_dir))
    return repeats.claims(found.withColumn("matches", F.col("matches").cast("long")).withColumn("mismatches", F.col("mismatches").cast("long")))


@query(f"""WITH {CANDIDATES_SQL}, x AS (SELECT c.*, t.i AS at_i, t.norm, regexp_matches(t.w, '[.?!]$') AS ends, t.source AS ts, t.norm <> '' AND NOT list_contains({STOP_SQL}, t.norm) AS content, t.i < c.i AS early, t.i >= c.i AND t.i < 2 * c.i - c.j AS again FROM cand c JOIN talk t ON t.project = c.project AND t.i BETWEEN c.j AND c.i + (c.i - c.j) + 9),
y AS (SELECT project, source, i, j, matches, mismatches, list(norm ORDER BY at_i) FILTER (early) AS en, list(norm ORDER BY at_i) FILTER (again) AS ln, coalesce(bool_or(ends) FILTER (early), false) AS done, coalesce(bool_or(ends) FILTER (at_i < i - 1), false) AS e_inner, coalesce(bool_or(ends) FILTER (at_i = i - 1), false) AS e_last,
  coalesce(bool_or(ends) FILTER (at_i >= i AND at_i < 2 * i - j - 1), false) AS l_inner, coalesce(bool_or(ends) FILTER (at_i = 2 * i - j - 1), false) AS l_last, count(DISTINCT ts) FILTER (again) AS l_sources, (i - 1) * 400 + 300 - j * 400 AS duration_ms,
  coalesce(list(DISTINCT norm) FILTER (early AND content), []) AS gone, coalesce(list(DISTINCT norm) FILTER (NOT early AND content), []) AS stay FROM x GROUP BY project, source, i, j, matches, mismatches),
z AS (SELECT *, coalesce(en = ln AND NOT e_inner AND NOT l_inner AND e_last AND l_last AND l_sources = 1, false) AS exact, CASE WHEN len(gone) > 0 THEN len(list_filter(gone, lambda g: NOT list_contains(stay, g))) / len(gone) ELSE 0.0 END AS missing FROM y)
SELECT project, source, i, j, matches, mismatches, duration_ms, exact, round(missing, 6) AS missing, CASE WHEN exact THEN 'drop' WHEN done OR duration_ms > 20000 THEN 'keep' ELSE 'drop' END AS action,
CASE WHEN exact THEN NULL WHEN done THEN 'complete_sentence' WHEN duration_ms > 20000 THEN 'long_segment' WHEN missing > 0.5 THEN 'retake_missing_content' END AS reason FROM z""")
def guard_cascade(spark, sf_dir):
    w = talk(spark, sf_dir)
    found = repeats.guarded(repeats.candidates(w), w).withColumn("missing", F.round("missing", 6))
    return found.withColumn("matches", F.col("matches").cast("long")).withColumn("mismatches", F.col("mismatches").cast("long"))


@query(f"""WITH {RUNS_SQL}, b AS (SELECT project, source, min(i) AS first_i, max(i) * 400 + 300 AS last_end FROM talk GROUP BY project, source),
p AS (SELECT *, lead(source) OVER (PARTITION BY project ORDER BY source) AS next_source, lead(first_i) OVER (PARTITION BY project ORDER BY source) AS next_i FROM b),
met AS (SELECT p.project, p.source, p.next_source, p.next_i AS i, a.i AS j, a.run AS ra, f.run AS rb, least(len(a.run), len(f.run), p.next_i - a.i) AS n FROM p JOIN r a ON a.project = p.project AND a.source = p.source AND p.last_end - a.i * 400 <= 90000 JOIN r f ON f.project = p.project AND f.i = p.next_i),{MATCH_SQL}
SELECT project, source, next_source, i, count(*) AS n_tail, max(j) FILTER (matches >= 3 AND (matches >= 5 OR content > 0)) AS nearest FROM mt GROUP BY project, source, next_source, i""")
def cross_source_repeat(spark, sf_dir):
    """The opening run of each turn against the turn before, as far back as the lookback: ``nearest`` is its nearest repeat."""
    return repeats.restarts(talk(spark, sf_dir))


@query(f"""WITH {TALK_SQL}, v AS (SELECT DISTINCT norm FROM talk WHERE length(norm) BETWEEN 9 AND 12 AND regexp_matches(norm, '^[a-z]+$'))
SELECT a.norm AS a, b.norm AS b, CAST(levenshtein(a.norm, b.norm) AS BIGINT) AS edits FROM v a JOIN v b ON substr(a.norm, 1, 4) = substr(b.norm, 1, 4) AND a.norm < b.norm AND abs(length(a.norm) - length(b.norm)) <= 2""")
def fuzzy_vocab(spark, sf_dir):
    """Pairs of the distinct vocabulary, blocked on four letters and length, each scored once.

    All pairs of a block are rows of the result, so blocks are dealt in parts: by both lengths, and the
    one side by hash while the other goes to every part.
    """
    v = talk(spark, sf_dir).where(F.length("norm").between(9, 12) & F.col("norm").rlike("^[a-z]+$")).select("norm").distinct()
    size, parts = F.length("norm"), 16
    a = v.select(F.col("norm").alias("a"), F.substring("norm", 1, 4).alias("key"), size.alias("n"), F.pmod(F.xxhash64("norm"), F.lit(parts)).cast("int").alias("part"))
    b = v.select(F.col("norm").alias("b"), F.substring("norm", 1, 4).alias("key"), F.explode(F.sequence(size - 2, size + 2)).alias("n")).select("b", "key", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = a.hint("shuffle_hash").join(b, ["key", "n", "part"]).where(F.col("a") < F.col("b"))
    return met.select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"))


LEAST_RATIO = 85


MOST_KEYS = 600  #: of one word for one length of the other, from deletions


def _fuzzy_class(short: int, long: int) -> tuple[int, int] | None:
    """The most letters that the shorter and the longer word of a pair of the least ratio lose; none if no two different words reach it."""
    spare = (short + long) * (100 - LEAST_RATIO) // 100 - (long - short)
    return (spare // 2, spare // 2 + long - short) if spare >= 0 and (spare >= 2 or short < long) else None


def _fuzzy_words(word: str, side: int, lengths: list[int]):
    """``(key, sure)``: every pair of the least ratio shares a key, one as the shorter (side 0), one as the longer word.

    Such a pair keeps a common subsequence of all but the few letters of ``_fuzzy_class``, so what is left
    of either word without so many letters is a key, and words that share it do reach the ratio (``sure``
    where at most one letter is in doubt).  Where that makes too many keys, the shorter word is cut into
    one segment more than there are edits: one of them stands in the longer word, moved by at most the
    deletions back or the insertions forward; such pairs are to be checked.
    """
    own = len(word)
    for other in lengths:
        short, long = (own, other) if side == 0 else (other, own)
        lost = _fuzzy_class(short, long) if short <= long else None
        if lost is None:
            continue
        if math.comb(long, lost[1]) <= MOST_KEYS:
            for left in {*itertools.combinations(word, own - lost[side])}:
                yield f"{short} {long} {''.join(left)}", lost[0] <= 1
            continue
        edits, deleted = (short + long) * (100 - LEAST_RATIO) // 100, lost[0]
        cuts = [short * k // (edits + 1) for k in range(edits + 2)]
        for k, (at, end) in enumerate(zip(cuts, cuts[1:])):
            for start in [at] if side == 0 else range(max(0, at - deleted), min(long - (end - at), at + deleted + long - short) + 1):
                yield f"{short} {long} {k} {word[start : start + end - at]}", False


def _fuzzy_keys(v: DataFrame, side: int, lengths: list[int], name: str) -> DataFrame:
    """Keys of all words as the shorter or the longer one of a pair, with the word as ``name``."""

    def run(batches):
        for batch in batches:
            for words in np.array_split(batch["norm"].to_numpy(), -(-len(batch) // 500)):
                out = {(word, key, sure) for word in words for key, sure in _fuzzy_words(word, side, lengths)}
                yield pd.DataFrame(out, columns=[name, "key", "sure"])

    return v.mapInPandas(run, f"{name} string, key string, sure boolean")


def fuzzy_pairs(v: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of different words ``norm`` with a ratio of at least ``LEAST_RATIO``."""
    v = v.select("norm").where("norm <> ''").distinct()
    lengths = sorted(r[0] for r in v.select(F.length("norm")).distinct().collect())  # as many as there are lengths
    v = v.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # each word makes many keys
    met = _fuzzy_keys(v, 0, lengths, "x").join(_fuzzy_keys(v, 1, lengths, "y").drop("sure").hint("merge"), "key").where("x <> y")  # far more keys than the table's size tells
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sure").distinct()
    total, apart = F.length("a") + F.length("b"), F.abs(F.length("a") - F.length("b"))
    edits = F.levenshtein("a", "b")
    # only insertions: the shorter word is a subsequence of the longer; else a sure pair lacks one letter of it
    common = (total - apart) / 2 - F.when(edits == apart, 0).otherwise(1)
    checked = F.when(edits <= F.floor(total * (100 - LEAST_RATIO) / 100), T.ratio(F.col("a"), F.col("b")))  # never more than insertions and deletions
    return pairs.select("a", "b", F.round(F.when(F.col("sure"), F.lit(200.0) * common / total).otherwise(checked), 6).alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)


@query()
def fuzzy_ratio(spark, sf_dir):
    """Indel similarity of all pairs of the whole vocabulary, those of at least 85."""
    return fuzzy_pairs(talk(spark, sf_dir).select("norm"))


@query(f"""WITH {WORDS_SQL}, sn AS (SELECT source, sent, string_agg(norm, ' ' ORDER BY i) AS s FROM words GROUP BY source, sent),
bt AS (SELECT item_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ls FROM benchmark),
ln AS (SELECT item_id, unnest(range(len(ls))) AS line, ls[line + 1] AS t FROM bt), nn AS (SELECT item_id, line, array_to_string(list_transform(string_split_regex(t, '\\s+'), lambda x: regexp_replace(lower(x), '\\p{{P}}', '', 'g')), ' ') AS s FROM ln)
SELECT item_id, CAST(line AS INTEGER) AS line, count(DISTINCT sn.source) AS n_sources FROM nn LEFT JOIN sn ON sn.s = nn.s GROUP BY item_id, line""")
def script_missing(spark, sf_dir):
    """How many documents say each script line, a sentence of an item, as one sentence (0: missing)."""
    w = words(spark, sf_dir)
    said = w.groupBy("source", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "norm"))), lambda x: x["norm"]), " ").alias("s"))
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("line", "text"))
    lines = lines.select("item_id", "line", F.array_join(F.transform(F.split("text", r"\s+"), T.normal), " ").alias("s"))
    return lines.join(said, "s", "left").groupBy("item_id", "line").agg(F.count_distinct("source").alias("n_sources"))


@query("""SELECT d.doc_id, d.source AS unit, d.n_chars >= 500 AS predicted, l.quality = 1 AS gold FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def interval_label(spark, sf_dir):
    return _labelled(spark, sf_dir)


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("unit"), (F.col("n_chars") >= 500).alias("predicted"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id")


CONFUSION_SQL = """l AS (SELECT d.source AS unit, d.n_chars >= 500 AS p, d.n_chars >= 2000 AS p2, l.quality = 1 AS g FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT count(*) FILTER (p AND g) AS b, count(*) FILTER (p) AS kept, count(*) FILTER (g) AS gold_kept, count(DISTINCT unit) FILTER (g AND NOT p) AS false_cut_units, count(*) FILTER (p AND NOT g) AS missed FROM l),
m AS (SELECT *, b / kept AS precision, b / gold_kept AS recall FROM c)"""


@query(f"WITH {CONFUSION_SQL} SELECT kept, gold_kept, false_cut_units, missed, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m")
def confusion(spark, sf_dir):
    c = scoring.confusion(_labelled(spark, sf_dir))
    return c.select("kept", "gold_kept", "false_cut_units", "missed", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("""WITH l AS (SELECT d.n_chars >= 500 AS p, d.n_chars >= 2000 AS p2, l.quality = 1 AS g FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT CAST(count(*) FILTER (p) AS DOUBLE) AS kept, CAST(count(*) FILTER (p AND NOT g) AS DOUBLE) AS missed, CAST(count(*) FILTER (p2) AS DOUBLE) AS kept2, CAST(count(*) FILTER (p2 AND NOT g) AS DOUBLE) AS missed2 FROM l)
SELECT 'kept' AS metric, kept AS "current", kept2 AS previous, kept - kept2 AS delta FROM a UNION ALL SELECT 'missed', missed, missed2, missed - missed2 FROM a""")
def metric_delta(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    longer = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 2000).alias("predicted"))
    before = rows.drop("predicted").join(longer, "doc_id")
    return scoring.delta(scoring.confusion(rows), scoring.confusion(before), ["kept", "missed"])


@query("""SELECT o_orderkey, o_custkey % 24 AS h, printf('%02d:%02d:%02d:%02d', o_custkey % 24, o_orderkey % 60, o_custkey % 60, o_orderkey % 25) AS code, CAST((((o_custkey % 24) * 60 + o_orderkey % 60) * 60 + o_custkey % 60) * 25 + o_orderkey % 25 AS BIGINT) AS frames FROM orders""")
def timecode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 24).alias("h"), F.format_string("%02d:%02d:%02d:%02d", F.col("o_custkey") % 24, F.col("o_orderkey") % 60, F.col("o_custkey") % 60, F.col("o_orderkey") % 25).alias("code"))
    return o.withColumn("frames", timing.timecode_frames(F.col("code"), F.lit(25)))


@query("""SELECT o_orderkey, CASE WHEN f = 0 THEN '0s' WHEN 30000 // gcd(f * 1001, 30000) = 1 THEN (f * 1001 // gcd(f * 1001, 30000)) || 's' ELSE (f * 1001 // gcd(f * 1001, 30000)) || '/' || (30000 // gcd(f * 1001, 30000)) || 's' END AS seconds FROM (SELECT o_orderkey, o_orderkey % 60001 AS f FROM orders)""")
def rational_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timing.rational(F.col("o_orderkey") % 60001, F.lit(30000).cast("long"), F.lit(1001).cast("long")).alias("seconds"))


@query("""SELECT p_partkey, p_name, round(20 * log10(greatest(p_retailprice / 1000, 1e-10)), 6) AS db, CASE WHEN (CASE WHEN p_partkey % 4 IN (1, 3) THEN p_size ELSE 20 END) > (CASE WHEN p_partkey % 4 IN (1, 3) THEN 20 ELSE p_size END) THEN 'short' ELSE 'long' END AS profile FROM part""")
def scalar_levels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", F.round(timing.decibels(F.col("p_retailprice") / 1000), 6).alias("db"), timing.orientation(F.col("p_size"), F.lit(20), F.col("p_partkey") % 4 * 90).alias("profile"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, first_value(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS want FROM customer)
SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_mktsegment <> want) AS n_off, min(c_custkey) FILTER (c_mktsegment <> want) AS first_off FROM c GROUP BY c_nationkey""")
def schema_uniformity(spark, sf_dir):
    """Rows that differ from the first of their group, and which is the first to."""
    c = table(spark, sf_dir, "customer").withColumn("want", F.first("c_mktsegment").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    off = F.col("c_mktsegment") != F.col("want")
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"), F.min(F.when(off, F.col("c_custkey"))).alias("first_off"))


@query("""SELECT s_suppkey, name, row_number() OVER (ORDER BY k) AS place FROM (SELECT s_suppkey, 'take' || s_suppkey || '.mov' AS name, 'take' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '.mov' AS k FROM supplier)""")
def natural_sort(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("take"), F.col("s_suppkey").cast("string"), F.lit(".mov")).alias("name"))
    return s.select("s_suppkey", "name", F.row_number().over(Window.orderBy(T.natural_key(F.col("name")))).cast("long").alias("place"))


@query("""SELECT n_regionkey, sha256(string_agg(n_name || ':' || sha256(CAST(n_nationkey AS VARCHAR)), chr(10) ORDER BY n_name)) AS digest FROM nation GROUP BY n_regionkey""")
def manifest_hash(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.concat_ws(":", "n_name", F.sha2(F.col("n_nationkey").cast("string"), 256)).alias("line"), "n_name")
    return n.groupBy("n_regionkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "line"))), lambda x: x["line"]), "\n"), 256).alias("digest"))


@query("""SELECT page_id, length(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '[*_`]', '', 'g')) AS n_chars FROM pages""")
def strip_markup(spark, sf_dir):
    plain = F.regexp_replace(T.strip_comments(F.col("html")), r"[*_`]", "")
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"))


@query(f"""WITH {WORDS_SQL}, {GROUP_SQL} SELECT (SELECT count(*) FROM words) AS words, (SELECT count(*) FROM ranges) AS ranges, (SELECT CAST(sum(out_ms - in_ms) AS BIGINT) FROM ranges) AS output_ms, (SELECT count(*) FROM words WHERE ends) AS sentence_ends, (SELECT count(*) FROM events WHERE event_type = 'error') AS claps""")
def run_summary(spark, sf_dir):
    w = words(spark, sf_dir).agg(F.count("*").alias("words"), F.count_if("ends").alias("sentence_ends"), F.lit(1).alias("k"))
    r = _ranges(spark, sf_dir).agg(F.count("*").alias("ranges"), F.sum(F.col("out_ms") - F.col("in_ms")).alias("output_ms"), F.lit(1).alias("k"))
    c = table(spark, sf_dir, "events").where("event_type = 'error'").agg(F.count("*").alias("claps"), F.lit(1).alias("k"))
    return w.join(r, "k").join(c, "k").drop("k")


@query(f"""WITH {WORDS_SQL} SELECT source, CAST(i AS BIGINT) AS i, printf('%.3f', "start" / 1000.0) AS at, w FROM words WHERE "start" >= 2000 AND "start" < 5000""")
def words_window(spark, sf_dir):
    w = words(spark, sf_dir).where("start >= 2000 AND start < 5000")
    return w.select("source", F.col("i").cast("long").alias("i"), F.format_string("%.3f", F.col("start") / 1000).alias("at"), "w")
