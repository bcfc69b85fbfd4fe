"""Queries that assemble transcripts, scripts, timelines, layouts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..operators import fillers, intervals, islands, script, timeline
from .carriers import FRAMES_SQL, SESSIONS_SQL, WORDS_SQL, frames, placed, sessions, table, words
from .catalogue import CUT_SQL, GROUP_SQL, _framed, _ranges
from .registry import query


def _before(*by: str, order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


@query(f"""WITH {WORDS_SQL}, n AS (SELECT w.source, d.source AS project, count(*) AS n, sum(CAST(ends AS BIGINT)) AS e, arg_max(ends, i) AS shut FROM words w JOIN documents d ON d.doc_id = w.source GROUP BY w.source, d.source),
o AS (SELECT source, project, coalesce(sum(n) OVER p, 0) AS first_i, coalesce(sum(e + CASE WHEN shut THEN 0 ELSE 1 END) OVER p, 0) AS first_sent FROM n WINDOW p AS (PARTITION BY project ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o.project, w.source, CAST(first_i + w.i AS BIGINT) AS i, CAST(first_sent + w.sent AS BIGINT) AS sent FROM words w JOIN o ON o.source = w.source""")
def word_assembly(spark, sf_dir):
    """Running word and sentence numbers over all sources of a project; a source's end ends its sentence, never twice.

    Only one row a source is numbered in order; words take their source's offsets, so a project may be of any size.
    """
    w = words(spark, sf_dir)
    own = w.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("ends").cast("long")).alias("e"), F.max_by("ends", "i").alias("shut"))
    own = own.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("source").alias("project")), "source")
    before = _before("project", order="source")
    offset = own.select("source", "project", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_i"), F.coalesce(F.sum(F.col("e") + F.when(F.col("shut"), 0).otherwise(1)).over(before), F.lit(0)).alias("first_sent"))
    return w.join(offset, "source").select("project", "source", (F.col("first_i") + F.col("i")).cast("long").alias("i"), (F.col("first_sent") + F.col("sent")).cast("long").alias("sent"))


_PIECES = """pc AS (SELECT source, k, tok, k * 100 AS "start", k * 100 + 100 AS "end" FROM (SELECT doc_id AS source, unnest(range(len(text) // 4 + CASE WHEN len(text) % 4 > 0 THEN 1 ELSE 0 END)) AS k, substr(replace(text, ' ', chr(9601)), CAST(k * 4 + 1 AS BIGINT), 4) AS tok FROM documents WHERE text <> ''))"""


@query(f"""WITH {_PIECES}, g AS (SELECT *, sum(CASE WHEN k > 0 AND (tok LIKE chr(9601) || '%' OR tok LIKE ' %') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS w FROM pc)
SELECT source, CAST(w AS BIGINT) AS word, ltrim(string_agg(tok, '' ORDER BY k), ' ' || chr(9601)) AS w, CAST(min("start") AS BIGINT) AS start_ms, CAST(max("end") AS BIGINT) AS end_ms FROM g GROUP BY source, w""")
def subword_times(spark, sf_dir):
    """Pieces that begin with a space or U+2581 start a word: its text, first start and last end."""
    cut = F.regexp_extract_all(F.translate("text", " ", "▁"), F.lit("(?s).{1,4}"), F.lit(0))  # one pass, whatever the length
    pieces = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("text <> ''").select(F.col("doc_id").alias("source"), F.posexplode(cut).alias("k", "tok"))
    starts = F.col("tok").startswith("▁") | F.col("tok").startswith(" ")
    made = islands.number(pieces, ["source"], ["k"], starts, "word")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tok"))), lambda x: x["tok"]), "")  # one word's pieces
    return made.groupBy("source", "word").agg(F.regexp_replace(joined, "^[ ▁]+", "").alias("w"), (F.min("k") * 100).cast("long").alias("start_ms"), (F.max("k") * 100 + 100).cast("long").alias("end_ms"))


@query(f"""WITH {WORDS_SQL}, j AS (SELECT source, i, "start" + CASE WHEN i % 11 = 0 THEN -430 WHEN i % 101 = 50 THEN -470 ELSE 0 END AS s, "start" + CASE WHEN i % 13 = 0 THEN -40 ELSE 300 END AS e, max("end") OVER (PARTITION BY source) - 20 AS d FROM words),
r AS (SELECT *, greatest(s, coalesce(max(s) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS up FROM j),
q AS (SELECT source, i, least(up, d) AS start_ms, least(greatest(e, least(up, d)), d) AS end_ms, greatest(up - s, least(up, d) - e, e - d, up - d, 0) AS off FROM r)
SELECT source, CAST(i AS BIGINT) AS i, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, CASE WHEN off = 0 THEN 'ok' WHEN off < 50 THEN 'clamped' ELSE 'error' END AS state FROM q""")
def timestamp_rule(spark, sf_dir):
    """Starts never fall, ends follow starts, nothing passes the duration: under 50 ms is clamped, more is an error row."""
    at, order = F.col("i"), Window.partitionBy("source").orderBy("i")
    w = words(spark, sf_dir).select("source", at, (F.col("start") + F.when(at % 11 == 0, -430).when(at % 101 == 50, -470).otherwise(0)).alias("s"), (F.col("start") + F.when(at % 13 == 0, -40).otherwise(300)).alias("e"), "end")
    w = w.join(w.groupBy("source").agg((F.max("end") - 20).alias("d")), "source")
    up = F.greatest("s", F.coalesce(F.max("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    w = w.withColumn("up", up).withColumn("start_ms", F.least("up", "d")).withColumn("end_ms", F.least(F.greatest("e", "start_ms"), "d"))
    off = F.greatest(F.col("up") - F.col("s"), F.col("start_ms") - F.col("e"), F.col("e") - F.col("d"), F.col("up") - F.col("d"), F.lit(0))
    return w.select("source", at.cast("long").alias("i"), "start_ms", "end_ms", F.when(off == 0, "ok").when(off < 50, "clamped").otherwise("error").alias("state"))


_SCRIPT = """'---' || chr(10) || 'title: x. y.' || chr(10) || '---' || chr(10) || 'Start of it. ' || chr(10) || '# Part *' || item_id || '*' || chr(10) || text || chr(10) || '<!-- not this. -->' || chr(10) || '### Aside' || chr(10) || 'A `line` here' || chr(10) || 'goes on. And [ends](u)!' || chr(10) || chr(10) || '```py' || chr(10) || 'code. not said' || chr(10) || '```' || chr(10) || '## Last' || chr(10) || replace(text, ' ', '  ')"""


@query(f"""WITH b AS (SELECT item_id AS script, regexp_replace(regexp_replace({_SCRIPT}, '\\A---[ \\t]*\\n(?s:.*?)\\n(?:---|\\.\\.\\.)[ \\t]*(?:\\n|\\z)', ''), '(?s)<!--.*?-->', '', 'g') AS t FROM benchmark),
l AS (SELECT script, unnest(range(len(ls))) AS line, ls[line + 1] AS t FROM (SELECT script, string_split(t, chr(10)) AS ls FROM b)),
f AS (SELECT *, t LIKE '```%' AS fence, sum(CASE WHEN t LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY script ORDER BY line ROWS UNBOUNDED PRECEDING) AS k FROM l),
h AS (SELECT *, regexp_extract(t, '^(#{{1,6}})[ \\t]+(.*?)[ \\t]*#*[ \\t]*$', 1) AS hs, regexp_replace(regexp_extract(t, '^(#{{1,6}})[ \\t]+(.*?)[ \\t]*#*[ \\t]*$', 2), '[*_`]', '', 'g') AS title FROM f WHERE NOT fence AND k % 2 = 0),
c AS (SELECT *, hs <> '' OR trim(t) = '' AS ends, last_value(CASE WHEN length(hs) IN (1, 2) THEN title END IGNORE NULLS) OVER (PARTITION BY script ORDER BY line ROWS UNBOUNDED PRECEDING) AS chapter FROM h),
p AS (SELECT *, sum(CAST(ends AS BIGINT)) OVER (PARTITION BY script ORDER BY line ROWS UNBOUNDED PRECEDING) AS par FROM c),
q AS (SELECT script, par, first(chapter) AS chapter, string_agg(trim(t), ' ' ORDER BY line) AS t FROM p WHERE NOT ends GROUP BY script, par),
s AS (SELECT script, chapter, par, unnest(range(len(ss))) AS a, ss[a + 1] AS t FROM (SELECT *, string_split(regexp_replace(t, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM q)),
x AS (SELECT script, chapter, par, a, trim(regexp_replace(regexp_replace(t, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`]', '', 'g')) AS t FROM s)
SELECT script, chapter, row_number() OVER (PARTITION BY script ORDER BY par, a) AS sentence, t AS text FROM x WHERE t <> ''""")
def script_parse(spark, sf_dir):
    """Benchmark items as Markdown scripts with front matter, headings, a comment and fenced code, to sentences."""
    b = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("script"), "text")
    text = F.concat(F.lit("---\ntitle: x. y.\n---\nStart of it. \n# Part *"), F.col("script").cast("string"), F.lit("*\n"), F.col("text"), F.lit("\n<!-- not this. -->\n### Aside\nA `line` here\ngoes on. And [ends](u)!\n\n```py\ncode. not said\n```\n## Last\n"), F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
    return script.parsed(b.select("script", text.alias("text")), F.col("text"))


_DROPS = """sd AS (SELECT source, sent, CAST(min(i) AS BIGINT) AS a, CAST(max(i) AS BIGINT) AS b, count(*) AS n FROM words GROUP BY source, sent), dr AS (SELECT * FROM sd WHERE n % 7 = 2),
kw AS (SELECT w.* FROM words w WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.source = w.source AND w.i BETWEEN dr.a AND dr.b))"""


def _drops(w: DataFrame) -> DataFrame:
    """Decisions on sentences: one whose length mod 7 is 2 is dropped."""
    s = w.groupBy("source", "sent").agg(F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word"), F.count("*").alias("n"), F.min("start").alias("start_ms"), F.max("end").alias("end_ms"))
    return s.where("n % 7 = 2")


@query(f"""WITH {WORDS_SQL}, {_DROPS}, g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY source ORDER BY i) > 1 OR "start" - lag("end") OVER (PARTITION BY source ORDER BY i) > 400 THEN 1 ELSE 0 END AS b FROM kw),
r AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS rn FROM g)
SELECT source, 'r' || lpad(CAST(rn + 1 AS VARCHAR), 5, '0') AS id, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, CAST(min("start") AS BIGINT) AS in_ms, CAST(max("end") AS BIGINT) AS out_ms, count(*) AS n_words FROM r GROUP BY source, rn""")
def kept_ranges(spark, sf_dir):
    """Ranges of kept words: a dropped word between two breaks them as a pause does; numbered in order."""
    w = words(spark, sf_dir)
    r = timeline.group(fillers.kept(w, _drops(w)))
    return r.select("source", F.format_string("r%05d", F.col("range_no") + 1).alias("id"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "in_ms", "out_ms", "n_words")


@query(f"""WITH {WORDS_SQL}, {_DROPS} SELECT source, 'd' || lpad(CAST(row_number() OVER (PARTITION BY dr.source ORDER BY dr.sent) AS VARCHAR), 4, '0') AS id, (SELECT CAST(min("start") AS BIGINT) FROM words w WHERE w.source = dr.source AND w.i = dr.a) AS start_ms, (SELECT CAST(max("end") AS BIGINT) FROM words w WHERE w.source = dr.source AND w.i = dr.b) AS end_ms FROM dr""")
def dropped_spans(spark, sf_dir):
    """The time span of every drop, in decision order."""
    return _drops(words(spark, sf_dir)).select("source", F.format_string("d%04d", F.row_number().over(Window.partitionBy("source").orderBy("sent"))).alias("id"), "start_ms", "end_ms")


@query(f"""WITH {WORDS_SQL}, {_DROPS}, ch AS (SELECT source, sent // 5 AS chapter, sent % 5 AS rnk, min(i) AS i, min("start") AS s FROM kw GROUP BY source, sent // 5, sent % 5)
SELECT source, CAST(chapter AS BIGINT) AS chapter, CAST(arg_min(i, rnk) AS BIGINT) AS at_word, CAST(arg_min(s, rnk) AS BIGINT) AS start_ms FROM ch GROUP BY source, chapter""")
def chapter_first(spark, sf_dir):
    """Five sentences make a chapter: its first kept word, by sentence order; chapters without one are left out."""
    w = words(spark, sf_dir)
    k = fillers.kept(w, _drops(w))
    return k.groupBy("source", F.floor(F.col("sent") / 5).cast("long").alias("chapter")).agg(F.min("i").cast("long").alias("at_word"), F.min("start").alias("start_ms"))


@query(f"""WITH {WORDS_SQL}, {_DROPS} SELECT sd.source, CAST(sd.sent AS BIGINT) AS sent, CAST(min(k.i) AS BIGINT) AS at_word FROM sd JOIN kw k ON k.source = sd.source AND k.i BETWEEN sd.a AND sd.b WHERE sd.n >= 12 AND (SELECT max("end") - min("start") FROM words w WHERE w.source = sd.source AND w.sent = sd.sent) >= 5000 GROUP BY sd.source, sd.sent""")
def unscripted_marker(spark, sf_dir):
    """Long runs of at least 5 s that no take holds: a marker on the first kept word of each."""
    w = words(spark, sf_dir)
    runs = fillers.marked(w, _drops(w)).groupBy("source", "sent").agg(F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("ms"), F.min(F.when(~F.col("dropped"), F.col("i"))).cast("long").alias("at_word"))
    return runs.where("n >= 12 AND ms >= 5000 AND at_word IS NOT NULL").select("source", "sent", "at_word")


@query(f"""WITH {WORDS_SQL}, {GROUP_SQL}, sp AS (SELECT source, in_ms + 90 AS s, out_ms - 200 AS e FROM ranges)
SELECT w.source, CAST(w.i AS BIGINT) AS i, EXISTS (SELECT 1 FROM sp WHERE sp.source = w.source AND (w."start" + w."end") // 2 >= s AND (w."start" + w."end") // 2 < e) AS kept FROM words w""")
def midpoint_label(spark, sf_dir):
    """Whether a half-open span of the same source holds a word's midpoint (whether, not which: no join)."""
    spans = _ranges(spark, sf_dir).select("source", (F.col("in_ms") + 90).alias("s"), (F.col("out_ms") - 200).alias("e")).where("s < e")
    w = words(spark, sf_dir).select("source", "i", F.expr("(start + end) div 2").alias("mid"))
    return intervals.held(w, spans, ["source"], "mid", "s", "e", "kept").select("source", F.col("i").cast("long").alias("i"), "kept")


@query(f"""WITH {WORDS_SQL}, {_DROPS}, x AS (SELECT w.source, w.sent, w."end" - w."start" AS ms, w.i % 3 > 0 AS gold, k.i IS NOT NULL AS kept FROM words w LEFT JOIN kw k ON k.source = w.source AND k.i = w.i)
SELECT source, count(*) FILTER (gold AND NOT kept) AS false_cut_words, count(DISTINCT sent) FILTER (gold AND NOT kept) AS false_cut_sentences, count(*) FILTER (kept AND NOT gold) AS missed_words,
round(CASE WHEN coalesce(sum(ms) FILTER (gold), 0) = 0 THEN 0.0 ELSE count(*) FILTER (kept AND NOT gold) / (sum(ms) FILTER (gold) / 600000.0) END, 6) AS missed_rate, round(CASE WHEN coalesce(sum(ms) FILTER (gold), 0) = 0 THEN 0.0 ELSE count(DISTINCT sent) FILTER (gold AND NOT kept) / (sum(ms) FILTER (gold) / 600000.0) END, 6) AS false_rate FROM x GROUP BY source""")
def eval_rates(spark, sf_dir):
    """False cuts and missed words of each source, as counts and per ten minutes of gold."""
    w = words(spark, sf_dir)
    x = fillers.marked(w, _drops(w))
    gold, kept_ = F.col("i") % 3 > 0, ~F.col("dropped")
    ms = F.coalesce(F.sum(F.when(gold, F.col("end") - F.col("start"))), F.lit(0))
    rate = lambda n: F.round(F.when(ms == 0, 0.0).otherwise(n / (ms / 600000.0)), 6)
    false_words, false_sents, missed = F.count_if(gold & ~kept_), F.count_distinct(F.when(gold & ~kept_, F.col("sent"))), F.count_if(kept_ & ~gold)
    return x.groupBy("source").agg(false_words.alias("false_cut_words"), false_sents.alias("false_cut_sentences"), missed.alias("missed_words"), rate(missed).alias("missed_rate"), rate(false_sents).alias("false_rate"))


@query(f"""WITH {WORDS_SQL}, {_DROPS}, d AS (SELECT source, sent, (SELECT min("start") FROM words w WHERE w.source = dr.source AND w.i = dr.a) AS s, (SELECT max("end") FROM words w WHERE w.source = dr.source AND w.i = dr.b) AS e FROM dr WHERE n > 2),
f AS (SELECT source, sent, (s * 30000) // 1001000 AS f0, (e * 30000 + 1000999) // 1001000 AS f1 FROM d)
SELECT source, CAST(sent AS BIGINT) AS sent, CAST(f0 AS BIGINT) AS in_frame, CAST(f1 - f0 AS BIGINT) AS frames, CAST(coalesce(sum(f1 - f0) OVER (PARTITION BY source ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f""")
def rejects_spine(spark, sf_dir):
    """Rejected spans laid end to end in frames; short ones (the fillers) are left out."""
    d = _drops(words(spark, sf_dir)).where("n > 2")
    first, last = timing.frame_range(F.col("start_ms"), F.col("end_ms"), F.lit(30000), F.lit(1001))
    d = d.select("source", F.col("sent").cast("long").alias("sent"), first.alias("in_frame"), (last - first).alias("frames"))
    return islands.running_offset(d, ["source"], ["sent"], "frames").select("source", "sent", "in_frame", "frames", "offset")


@query(CUT_SQL + """, ch AS (SELECT source, sent // 5 AS chapter, min(i) AS at_word FROM words GROUP BY source, sent // 5)
SELECT ch.source, CAST(ch.chapter AS BIGINT) AS chapter, f.range_no, least(greatest((w."start" * 30000) // 1001000, f.in_frame), f.out_frame - 1) AS at_frame
FROM ch JOIN words w ON w.source = ch.source AND w.i = ch.at_word JOIN framed f ON f.source = ch.source AND ch.at_word BETWEEN f.first_word AND f.last_word""")
def chapter_placement(spark, sf_dir):
    """Each chapter once, in the range that holds its first word, at that word's frame."""
    ch = words(spark, sf_dir).groupBy("source", F.floor(F.col("sent") / 5).cast("long").alias("chapter")).agg(F.min("i").cast("long").alias("at_word"), F.min("start").alias("start"))
    r = _framed(spark, sf_dir).select("source", "range_no", "first_word", F.col("last_word").alias("until"), "in_frame", "out_frame")
    met = intervals.within(ch, r, ["source"], "at_word", "first_word", "until", 512, closed=True)
    return met.select("source", "chapter", "range_no", timing.clamp(timing.first_frame(F.col("start"), F.lit(30000), F.lit(1001)), F.col("in_frame"), F.col("out_frame") - 1).alias("at_frame"))


@query(CUT_SQL + """, o AS (SELECT source, range_no, in_frame, out_frame, sum(out_frame - in_frame) OVER (PARTITION BY source ORDER BY range_no ROWS UNBOUNDED PRECEDING) - (out_frame - in_frame) AS o_at FROM framed)
SELECT source, count(*) AS n, count(*) FILTER (out_frame <= in_frame) AS empty, count(*) FILTER (o_at < 0) AS before_start, CAST(max(o_at + out_frame - in_frame) AS BIGINT) AS total FROM o GROUP BY source""")
def layout_invariants(spark, sf_dir):
    """Rows that break the layout's rules, by source: no empty range, offsets that follow on; and the total."""
    r = _framed(spark, sf_dir).withColumn("frames", F.col("out_frame") - F.col("in_frame"))
    o = islands.running_offset(r, ["source"], ["range_no"], "frames")
    return o.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("frames") <= 0).alias("empty"), F.count_if(F.col("offset") < 0).alias("before_start"), F.max(F.col("offset") + F.col("frames")).alias("total"))


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT source, k // 8 AS frame, sqrt(avg(level * level)) AS rms, count(*) AS n FROM frames GROUP BY source, k // 8) SELECT source, CAST(frame AS BIGINT) AS frame, round(rms, 6) AS rms, n FROM p""")
def rms_resample(spark, sf_dir):
    """Tumbling windows of eight samples (the last one short): root of the mean square."""
    return frames(spark, sf_dir).groupBy("source", F.floor(F.col("k") / 8).cast("long").alias("frame")).agg(F.round(F.sqrt(F.avg(F.col("level") * F.col("level"))), 6).alias("rms"), F.count("*").alias("n"))


@query(f"""WITH {SESSIONS_SQL}, g AS (SELECT source, session, "start" AS s, "end" AS e FROM sessions WHERE "end" - "start" >= 3600000) SELECT f.source, f.k FROM frames f WHERE f.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = f.source AND f.ts >= g.s AND f.ts <= g.e)""")
def gated_onsets(spark, sf_dir):
    """Events outside every voiced run of at least an hour (closed at both ends): an anti interval join."""
    gate = sessions(spark, sf_dir).where(F.col("end") - F.col("start") >= 3_600_000)
    f = frames(spark, sf_dir).where("event_type = 'error'").select("source", "k", "ts")
    inside = intervals.within(f, gate, ["source"], "ts", "start", "end", 86_400_000, closed=True).select("source", "k")
    return f.join(inside, ["source", "k"], "left_anti").select("source", "k")


@query(f"""WITH {FRAMES_SQL}, q AS (SELECT source, k, level, level < 20 AS quiet FROM frames), g AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM q),
r AS (SELECT source, v, min(k) AS a, count(*) AS n FROM g WHERE quiet GROUP BY source, v), w AS (SELECT source, k // 10 AS word, min(k) AS f, max(k) AS l, min(k) FILTER (NOT quiet) AS voiced FROM g GROUP BY source, k // 10)
SELECT w.source, CAST(w.word AS BIGINT) AS word, (SELECT CAST(min(r.a) AS BIGINT) FROM r WHERE r.source = w.source AND r.n >= 2 AND r.a > w.voiced AND r.a BETWEEN w.f AND w.l) AS voice_end FROM w""")
def voice_end(spark, sf_dir):
    """Ten frames make a word: the first quiet run of two frames or more that starts in it after a voiced frame."""
    g = islands.number(frames(spark, sf_dir).withColumn("quiet", F.col("level") < 20), ["source"], ["k"], ~F.col("quiet"), "v")
    runs = g.where("quiet").groupBy("source", "v").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n >= 2").select("source", F.floor(F.col("a") / 10).cast("long").alias("word"), "a")
    w = g.groupBy("source", F.floor(F.col("k") / 10).cast("long").alias("word")).agg(F.min(F.when(~F.col("quiet"), F.col("k"))).alias("voiced"))
    # a run belongs to one word, so this is an equi-join
    return w.join(runs, ["source", "word"], "left").groupBy("source", "word").agg(F.min(F.when(F.col("a") > F.col("voiced"), F.col("a"))).alias("voice_end"))


@query(f"""WITH {WORDS_SQL}, {GROUP_SQL} SELECT r.source, r.range_no, 'take' || r.source || '.mov' AS name, r.in_ms, r.out_ms FROM ranges r JOIN documents d ON d.doc_id = r.source""")
def predicted_spans(spark, sf_dir):
    """Ranges by file name; a source that the catalog does not have raises."""
    catalog = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.format_string("take%d.mov", F.col("doc_id")).alias("file"))
    name = F.coalesce("file", F.raise_error(F.concat(F.lit("unknown source: "), F.col("source").cast("string"))).cast("string"))
    return _ranges(spark, sf_dir).join(catalog, "source", "left").select("source", "range_no", name.alias("name"), "in_ms", "out_ms")


@query(f"""WITH {WORDS_SQL}, {_DROPS}, {GROUP_SQL}, s AS (SELECT source, max("end") AS ms, count(DISTINCT sent // 5) AS chapters, count(*) AS words FROM words GROUP BY source), o AS (SELECT source, sum(out_ms - in_ms) AS ms, count(*) AS n FROM ranges GROUP BY source), d AS (SELECT source, count(*) AS n, count(*) FILTER (n = 2) AS short FROM dr GROUP BY source)
SELECT d0.source AS project, count(*) AS sources, CAST(sum(s.words) AS BIGINT) AS words, CAST(sum(s.chapters) AS BIGINT) AS chapters, CAST(sum(o.n) AS BIGINT) AS ranges, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS drops, CAST(coalesce(sum(d.short), 0) AS BIGINT) AS filler_drops,
round(sum(s.ms) / 1000.0, 3) AS raw_s, round(sum(o.ms) / 1000.0, 3) AS output_s, round(CASE WHEN sum(s.ms) = 0 THEN 0.0 ELSE sum(o.ms) / CAST(sum(s.ms) AS DOUBLE) END, 6) AS speech_share
FROM s JOIN documents d0 ON d0.doc_id = s.source LEFT JOIN o ON o.source = s.source LEFT JOIN d ON d.source = s.source GROUP BY d0.source""")
def run_counts(spark, sf_dir):
    """The run's counters of every project: words, chapters, ranges, drops, seconds and the share of speech."""
    w = words(spark, sf_dir)
    s = w.groupBy("source").agg(F.max("end").alias("ms"), F.count_distinct(F.floor(F.col("sent") / 5)).alias("chapters"), F.count("*").alias("words"))
    o = _ranges(spark, sf_dir).groupBy("source").agg(F.sum(F.col("out_ms") - F.col("in_ms")).alias("out"), F.count("*").alias("ranges"))
    d = _drops(w).groupBy("source").agg(F.count("*").alias("drops"), F.count_if(F.col("n") == 2).alias("short"))
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("source").alias("project"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = F.when(total("ms") == 0, 0.0).otherwise(total("out") / total("ms"))
    return s.join(p, "source").join(o, "source", "left").join(d, "source", "left").groupBy("project").agg(
        F.count("*").alias("sources"), total("words").alias("words"), total("chapters").alias("chapters"), total("ranges").alias("ranges"), total("drops").alias("drops"), total("short").alias("filler_drops"),
        F.round(total("ms") / 1000, 3).alias("raw_s"), F.round(total("out") / 1000, 3).alias("output_s"), F.round(share, 6).alias("speech_share"),
    )
