"""Queries on verdicts, takes, markers and the run's own records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, judge, takes
from .carriers import SESSIONS_SQL, WORDS_SQL, frames, sessions, table, words
from .registry import query

_DECIDED = """dc AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'keep' ELSE 'drop' END AS action, c_custkey % 5 <> 4 AS flagged, CASE c_custkey % 5 WHEN 0 THEN 'long_segment' WHEN 1 THEN 'retake_missing_content' WHEN 2 THEN 'complete_sentence' WHEN 3 THEN 'long_segment' END AS flag_reason,
CASE c_custkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'both' WHEN 3 THEN 'none' WHEN 4 THEN 'B' ELSE 'A' END AS choice, (c_custkey % 13) / 10.0 AS conf, c_custkey % 17 AS k FROM customer)"""
_VERDICT = "flagged AND flag_reason IN ('long_segment', 'retake_missing_content') AND choice IN ('A', 'B', 'both') AND conf <= 1 AND k NOT IN (0, 1, 2)"


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions, and replies of which some are no JSON, have a boolean confidence or too long a reason, or are missing."""
    key = F.col("c_custkey")
    reasons, choices = ["long_segment", "retake_missing_content", "complete_sentence", "long_segment"], ["A", "B", "both", "none", "B", "A", "A"]
    c = table(spark, sf_dir, "customer")
    d = c.select(key.alias("id"), F.when(key % 3 == 0, "keep").otherwise("drop").alias("action"), (key % 5 != 4).alias("flagged"), F.try_element_at(F.array(*map(F.lit, reasons)), (key % 5 + 1).cast("int")).alias("flag_reason"))
    choice = F.element_at(F.array(*map(F.lit, choices)), (key % 7 + 1).cast("int"))
    confidence = F.when(key % 17 == 0, "true").otherwise(F.format_string("%.1f", key % 13 / 10))
    reason = F.when(key % 17 == 1, F.repeat(F.lit("x"), 301)).otherwise("clear")
    json = F.concat(F.lit('{"choice":"'), choice, F.lit('","confidence":'), confidence, F.lit(',"reason":"'), reason, F.lit('"}'))
    return d, c.select(key.alias("id"), F.when(key % 17 != 2, json).alias("reply"))


@query(f"""WITH {_DECIDED}, v AS (SELECT *, {_VERDICT} AS ok FROM dc) SELECT id, CASE WHEN NOT coalesce(ok, false) THEN action WHEN conf < 0.7 THEN 'keep' WHEN choice = 'B' THEN 'drop' ELSE 'keep' END AS action,
CASE WHEN NOT coalesce(ok, false) THEN flagged WHEN conf < 0.7 OR choice = 'A' THEN true ELSE false END AS flagged, CASE WHEN NOT coalesce(ok, false) OR conf < 0.7 THEN flag_reason WHEN choice = 'A' THEN 'judge_prefers_first_take' END AS flag_reason FROM v""")
def verdict_apply(spark, sf_dir):
    """Eligible decisions after their sound verdicts."""
    return judge.applied(*_decided(spark, sf_dir))


@query(f"""WITH {_DECIDED} SELECT id, choice, CAST(conf AS DOUBLE) AS confidence FROM dc WHERE choice IN ('A', 'B', 'both') AND conf <= 1 AND k NOT IN (0, 1, 2)""")
def verdict_parse(spark, sf_dir):
    """Replies that are sound verdicts."""
    _, replies = _decided(spark, sf_dir)
    return replies.select("id", judge.verdict(F.col("reply")).alias("v")).where("v IS NOT NULL").select("id", "v.choice", "v.confidence")


@query(f"""WITH {_DECIDED} SELECT id, action, flagged, flag_reason FROM dc""")
def verdict_failsafe(spark, sf_dir):
    """With one endpoint out of reach (nation 7's here) no decision changes."""
    d, replies = _decided(spark, sf_dir)
    reach = table(spark, sf_dir, "nation").agg(F.bool_and(F.col("n_nationkey") != 7).alias("up"))
    return judge.applied(d, replies.crossJoin(F.broadcast(reach)).withColumn("reply", F.when(F.col("up"), F.col("reply"))).drop("up"))


@query(f"""WITH {WORDS_SQL}, st AS (SELECT source, sent, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM words GROUP BY source, sent),
x AS (SELECT source, sent, n, t, lag(t, 2) OVER w AS t2, lag(t, 1) OVER w AS t1, lead(t, 1) OVER w AS b, lead(t, 2) OVER w AS after FROM st WINDOW w AS (PARTITION BY source ORDER BY sent))
SELECT source, CAST(sent AS BIGINT) AS id, concat_ws(' ', t2, t1) AS before, t AS a, b, after FROM x WHERE n % 7 = 2""")
def judge_context(spark, sf_dir):
    """The sentences around each decision."""
    w = words(spark, sf_dir)
    spans = w.groupBy("source", "sent").agg(F.count("*").alias("n")).where("n % 7 = 2").select("source", F.col("sent").alias("id"), "sent")
    return judge.contexts(w, spans)


_TAKES = """tk AS (SELECT o_custkey AS project, o_orderkey % 5 AS sentence, o_orderkey % 1000 AS first_word, o_orderkey % 1000 + o_orderkey % 37 AS last_word, CAST(80 + o_orderkey % 21 AS DOUBLE) AS score FROM orders)"""


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), (k % 5).alias("sentence"), (k % 1000).alias("first_word"), (k % 1000 + k % 37).alias("last_word"), (80 + k % 21).cast("double").alias("score"))


@query(f"""WITH {_TAKES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, sentence ORDER BY score DESC, first_word DESC) AS r FROM tk) WHERE r = 1""".replace("SELECT * FROM (", "SELECT project, sentence, first_word, last_word, score FROM ("))
def chosen_take(spark, sf_dir):
    return takes.chosen(_takes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TAKES}, o AS (SELECT *, row_number() OVER (PARTITION BY project, sentence ORDER BY score DESC, first_word DESC, last_word DESC) AS r FROM (SELECT DISTINCT * FROM tk)),
g AS (SELECT project, sentence, r, first_word, last_word, score, true AS stay, [first_word * 10000 + last_word] AS held FROM o WHERE r = 1 UNION ALL
SELECT o.project, o.sentence, o.r, o.first_word, o.last_word, o.score, len(list_filter(g.held, lambda h: o.first_word <= h % 10000 AND h // 10000 <= o.last_word)) = 0,
CASE WHEN len(list_filter(g.held, lambda h: o.first_word <= h % 10000 AND h // 10000 <= o.last_word)) = 0 THEN list_append(g.held, o.first_word * 10000 + o.last_word) ELSE g.held END FROM g JOIN o ON o.project = g.project AND o.sentence = g.sentence AND o.r = g.r + 1)
SELECT project, sentence, first_word, last_word, score FROM g WHERE stay""")
def take_suppression(spark, sf_dir):
    """Greedy choice of takes without overlap, by sentence."""
    return takes.suppressed(_takes(spark, sf_dir).distinct())


@query(f"""WITH RECURSIVE {_TAKES}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sentence, first_word, last_word) AS r FROM (SELECT DISTINCT * FROM tk)),
p AS (SELECT project, r, sentence, last_word, score AS total FROM o UNION ALL SELECT o.project, o.r, o.sentence, o.last_word, p.total + o.score FROM p JOIN o ON o.project = p.project AND o.sentence > p.sentence AND o.first_word > p.last_word)
SELECT project, max(total) AS total FROM p GROUP BY project""")
def monotone_takes(spark, sf_dir):
    """The largest sum of scores that a monotone choice of takes reaches in each project."""
    return takes.monotone(_takes(spark, sf_dir).distinct()).groupBy("project").agg(F.sum("score").alias("total"))


@query(f"""WITH {_TAKES}, t AS (SELECT DISTINCT * FROM tk), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, sentence ORDER BY score DESC, first_word DESC) AS r FROM t) WHERE r = 1)
SELECT t.project, t.sentence, t.first_word, t.last_word, 'drop' AS action, CASE WHEN b.score - t.score < 5 THEN 'script_close_call' END AS flag_reason FROM t JOIN b ON b.project = t.project AND b.sentence = t.sentence AND t.first_word <> b.first_word
WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.project = t.project AND u.first_word <= t.last_word AND t.first_word <= u.last_word AND NOT (u.sentence = t.sentence AND u.first_word = t.first_word AND u.last_word = t.last_word AND u.score = t.score))""")
def script_alternates(spark, sf_dir):
    """Decisions on takes that were not chosen and overlap no other take."""
    t = _takes(spark, sf_dir).distinct()
    return takes.alternates(t, takes.chosen(t))


@query(f"""WITH {SESSIONS_SQL}, m AS (SELECT DISTINCT s.source, s.session FROM sessions s JOIN frames f ON f.source = s.source AND f.event_type = 'purchase' AND f.ts >= s."start" AND f.ts <= s."end"), u AS (SELECT s.* FROM sessions s WHERE "end" - "start" >= 3600000 AND NOT EXISTS (SELECT 1 FROM m WHERE m.source = s.source AND m.session = s.session))
SELECT u.source, u.session, coalesce((SELECT min(m.session) FROM m WHERE m.source = u.source AND m.session >= u.session), (SELECT max(m.session) FROM m WHERE m.source = u.source)) AS at_session FROM u""")
def unheard_marker(spark, sf_dir):
    """Long sessions in which nothing is heard: a marker on the next one that is, else on the last."""
    s = sessions(spark, sf_dir)
    buys = frames(spark, sf_dir).where("event_type = 'purchase'").select("source", "ts")
    heard = intervals.within(buys, s, ["source"], "ts", "start", "end", 86_400_000, closed=True).select("source", "session").distinct()
    quiet = s.where(F.col("end") - F.col("start") >= 3_600_000).join(heard, ["source", "session"], "left_anti").select("source", "session")
    both = quiet.withColumn("heard", F.lit(None).cast("long")).unionByName(heard.select("source", "session", F.col("session").alias("heard")))
    order = Window.partitionBy("source").orderBy("session")
    to = F.coalesce(F.first("heard", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.max("heard").over(Window.partitionBy("source")))
    return both.withColumn("at_session", to).where("heard IS NULL").select("source", "session", "at_session")


@query(f"""WITH {SESSIONS_SQL}, z AS (SELECT source, ts - 3600000 AS zs, ts + 3600000 AS ze FROM frames WHERE event_type = 'error') SELECT DISTINCT s.source, s.session FROM sessions s JOIN z ON z.source = s.source AND s."start" < z.ze AND z.zs < s."end" """)
def zone_marker(spark, sf_dir):
    """One marker on every session that overlaps a zone about an error."""
    from .catalogue import zone_hits

    return zone_hits(spark, sf_dir).select("source", "session")


@query(f"""WITH {WORDS_SQL}, t AS (SELECT source, i, i % 40 < 25 AS taken FROM words), g AS (SELECT *, sum(CAST(taken AS BIGINT)) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT source, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word FROM g WHERE NOT taken GROUP BY source, k""")
def unscripted_runs(spark, sf_dir):
    """Maximal runs of words that no take holds."""
    order = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = words(spark, sf_dir).select("source", "i", (F.col("i") % 40 < 25).alias("taken"))
    g = t.withColumn("k", F.sum(F.col("taken").cast("long")).over(order)).where(~F.col("taken"))
    return g.groupBy("source", "k").agg(F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word")).drop("k")


@query("""SELECT o_orderkey AS key, CASE WHEN l.digest IS NULL THEN 'miss' WHEN l.digest = sha256(o_orderstatus || ':' || o_orderkey) AND l.version = 2 THEN 'hit' ELSE 'stale' END AS state
FROM orders o LEFT JOIN (SELECT l_orderkey, sha256(CASE WHEN l_orderkey % 3 = 0 THEN 'X' ELSE any_value(o_orderstatus) END || ':' || l_orderkey) AS digest, 2 - l_orderkey % 2 AS version FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""")
def cache_hit(spark, sf_dir):
    """Stage results that are still good: version and digest of the inputs equal the recorded ones."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    digest = lambda status: F.sha2(F.concat_ws(":", status, F.col("o_orderkey").cast("string")), 256)
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    known = o.join(made, "o_orderkey", "left_semi").where(F.col("o_orderkey") % 5 != 0).select("o_orderkey", digest(F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("digest"), (2 - F.col("o_orderkey") % 2).alias("version"))
    state = F.when(F.col("digest").isNull(), "miss").when((F.col("digest") == digest(F.col("o_orderstatus"))) & (F.col("version") == 2), "hit").otherwise("stale")
    return o.join(known, "o_orderkey", "left").select(F.col("o_orderkey").alias("key"), state.alias("state"))


@query(f"""WITH {WORDS_SQL.strip()},
o AS (SELECT *, lag("start") OVER q AS ps, lag("end") OVER q AS pe FROM words WINDOW q AS (PARTITION BY source ORDER BY i)),
r AS (SELECT *, CASE WHEN "start" - pe > 1000 THEN NULL ELSE greatest(pe + 120, (ps + pe) // 2 + 1) END AS lower FROM o),
z AS (SELECT source, "end" + 250 AS zs, "end" + 550 AS ze FROM words WHERE regexp_matches(w, '[.?!,;:]$')),
j AS (SELECT r.*, z.ze FROM r ASOF LEFT JOIN z ON r.source = z.source AND r.lower <= z.zs),
b AS (SELECT *, CASE WHEN pe IS NULL THEN 0 WHEN lower IS NULL THEN 1 WHEN ze <= "start" - 80 AND 2 * ze < "start" + "end" THEN 1 ELSE 0 END AS b FROM j),
n AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS range_no FROM b)
SELECT source, CAST(range_no AS BIGINT) AS range_no, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, CAST(count(*) AS BIGINT) AS n_words FROM n GROUP BY source, range_no""")
def zone_split(spark, sf_dir):
    """Ranges of words with pauses up to a second, split on zones that lie 250 to 550 ms behind a word with punctuation."""
    from ..operators import islands, timeline

    w = words(spark, sf_dir)
    zones = w.where(F.col("w").rlike("[.?!,;:]$")).select("source", (F.col("end") + 250).alias("zs"), (F.col("end") + 550).alias("ze"))
    ranges = islands.number(w, ["source"], ["i"], F.col("start") - islands.before("end", ["source"], ["i"]) > 1000, "range_no")
    made = timeline.split_on_zones(ranges, zones)
    count = made.groupBy("source", "range_no").agg(F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word"), F.count("*").alias("n_words"))
    return count.select("source", F.col("range_no").cast("long").alias("range_no"), "first_word", "last_word", "n_words")
