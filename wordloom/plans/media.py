"""Queries on media records, made from the driver's part, supplier and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media, timing
from .carriers import WORDS_SQL, table, words
from .registry import query

_MEDIA = """m AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 30000 ELSE 25 END AS num, CASE WHEN p_size % 2 = 0 THEN 1001 ELSE 1 END AS den, CASE WHEN p_size % 5 = 0 THEN 24000 WHEN p_size % 2 = 0 THEN 30000 ELSE 25 END AS an,
CASE WHEN p_size % 5 = 0 OR p_size % 2 = 0 THEN 1001 ELSE 1 END AS ad, CAST(round(p_retailprice * 100) AS BIGINT) AS ms, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 900 END AS ticks, p_size, p_name FROM part)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, fifth = F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 0
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_name", F.when(even, 30000).otherwise(25).alias("num"), F.when(even, 1001).otherwise(1).alias("den"),
        F.when(fifth, 24000).when(even, 30000).otherwise(25).alias("an"), F.when(fifth | even, 1001).otherwise(1).alias("ad"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("ms"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 900).alias("ticks"),
    )


@query(f"""WITH {_MEDIA} SELECT p_partkey, CAST(round(num * 1.0 / den) AS BIGINT) AS nominal, (ms * num) // (den * 1000) AS frames, num * ad <> an * den AS vfr, round(coalesce(ticks / 90000.0, ms / 1000.0), 6) AS seconds FROM m""")
def probe_rates(spark, sf_dir):
    """Nominal rate, whole frames, variable-rate flag and duration by ticks of every record."""
    m = records(spark, sf_dir)
    seconds = media.tick_duration(F.col("ticks"), F.lit(1), F.lit(90000), (F.col("ms") / 1000).cast("string"))
    return m.select("p_partkey", timing.nominal_rate(F.col("num"), F.col("den")).alias("nominal"), media.duration_frames(F.col("ms"), F.col("num"), F.col("den")).alias("frames"), media.varies(F.col("num"), F.col("den"), F.col("an"), F.col("ad")).alias("vfr"), F.round(seconds, 6).alias("seconds"))


@query(f"""WITH {_MEDIA} SELECT p_partkey, CAST(1920 AS BIGINT) AS width, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, num * ad <> an * den AS varies, CAST(1 + p_size % 3 AS BIGINT) AS channels,
CASE WHEN p_size % 4 = 0 THEN '01:00:00:0' || p_size % 10 WHEN p_size % 4 = 1 THEN '02:00:00:00' ELSE '00:00:00:00' END AS timecode, round(coalesce(ticks / 90000.0, ms / 1000.0), 6) AS seconds FROM m""")
def probe_parse(spark, sf_dir):
    """Probe JSON of every record, written and parsed again: first streams, fallbacks for time code and duration."""
    m = records(spark, sf_dir)
    rate = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    tags = lambda when, code: F.when(when, F.struct(code.alias("timecode")))
    quarter, none = F.col("p_size") % 4, F.lit(None).cast("string")
    stream = lambda kind, **own: F.struct(F.lit(kind).alias("codec_type"), *[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("width", "long"), ("height", "long"), ("r_frame_rate", "string"), ("avg_frame_rate", "string"), ("channels", "long"), ("sample_rate", "string"), ("duration_ts", "long"), ("time_base", "string"), ("tags", "struct<timecode:string>"))])
    video = stream("video", width=F.lit(1920), height=F.lit(1080), r_frame_rate=rate("num", "den"), avg_frame_rate=rate("an", "ad"), duration_ts=F.col("ticks"), time_base=F.lit("1/90000"), tags=tags(quarter == 0, F.concat(F.lit("01:00:00:0"), (F.col("p_size") % 10).cast("string"))))
    audio = stream("audio", channels=1 + F.col("p_size") % 3, sample_rate=F.lit("48000"))
    late = stream("video", width=F.lit(640), height=F.lit(360), r_frame_rate=F.lit("10/1"), avg_frame_rate=F.lit("10/1"))
    whole = F.struct((F.col("ms") / 1000).cast("string").alias("duration"), tags(quarter == 1, F.lit("02:00:00:00")).alias("tags"))
    json = F.to_json(F.struct(F.array(audio, video, late).alias("streams"), whole.alias("format")))
    got = media.probed(json)
    return m.select("p_partkey", got.alias("g")).select("p_partkey", *[f"g.{c}" for c in ("width", "num", "den", "varies", "channels", "timecode")], F.round("g.seconds", 6).alias("seconds"))


@query("""WITH f(w, h, fd, name) AS (VALUES (1920, 1080, '1001/30000s', 'FFVideoFormat1080p2997'), (1920, 1080, '1/25s', 'FFVideoFormat1080p25'), (3840, 2160, '1001/30000s', 'FFVideoFormat2160p2997'), (3840, 2160, '1/25s', 'FFVideoFormat2160p25')),
m AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 3840 ELSE 1920 END AS w, CASE WHEN p_size % 3 = 0 THEN 2160 WHEN p_size % 3 = 1 THEN 1080 ELSE 1920 END AS h, CASE WHEN p_size % 2 = 0 THEN '1001/30000s' ELSE '1/25s' END AS fd, p_size FROM part)
SELECT p_partkey, f.name AS format_name, CASE WHEN p_size % 4 = 1 THEN 'mono' WHEN p_size % 4 = 2 THEN 'stereo' ELSE 'surround' END AS layout, CASE WHEN p_size % 2 = 0 THEN '48k' ELSE '44.1k' END AS rate FROM m LEFT JOIN f ON f.w = m.w AND f.h = m.h AND f.fd = m.fd""")
def format_lookup(spark, sf_dir):
    """Format names by a lookup of four rows (null where unknown), audio layout and rate tokens."""
    known = spark.createDataFrame([(w, h, d, f"FFVideoFormat{h}p{n}") for w, h in ((1920, 1080), (3840, 2160)) for d, n in (("1001/30000s", "2997"), ("1/25s", "25"))], "w int, h int, fd string, format_name string")
    third = F.col("p_size") % 3
    m = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(third == 0, 3840).otherwise(1920).alias("w"), F.when(third == 0, 2160).when(third == 1, 1080).otherwise(1920).alias("h"), F.when(F.col("p_size") % 2 == 0, "1001/30000s").otherwise("1/25s").alias("fd"))
    channels = F.when(F.col("p_size") % 4 == 0, 4).otherwise(F.col("p_size") % 4)
    return m.join(F.broadcast(known), ["w", "h", "fd"], "left").select("p_partkey", "format_name", media.layout(channels).alias("layout"), media.rate_token(F.when(F.col("p_size") % 2 == 0, 48000).otherwise(44100)).alias("rate"))


@query("""SELECT s_suppkey, 'file:///raw/' || replace(replace(s_name, '#', '%23'), ' ', '%20') || '%20%26%20a%2B.mov' AS uri, s_name || ' & a+.mov' AS name, s_name || ' rough cut' AS event, CASE WHEN s_suppkey % 2 = 0 THEN 'filler' ELSE 'retake' END AS kind FROM supplier""")
def asset_names(spark, sf_dir):
    """File URIs, the names decoded from them, filled templates and the kind a decision id tells."""
    s = table(spark, sf_dir, "supplier").withColumn("uri", media.file_uri(F.concat(F.lit("/raw/"), F.col("s_name"), F.lit(" & a+.mov"))))
    kind = media.reject_kind(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "f").otherwise("d"), F.col("s_suppkey").cast("string")))
    return s.select("s_suppkey", "uri", media.uri_name(F.col("uri")).alias("name"), media.filled(F.lit("{project} rough cut"), F.col("s_name")).alias("event"), kind.alias("kind"))


@query("""SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN p_size ELSE p_size * 10 + 5 END * CASE p_size % 3 WHEN 0 THEN 1001 WHEN 1 THEN 1 ELSE 10 END AS BIGINT) AS num, CAST(CASE p_size % 3 WHEN 0 THEN 30000 WHEN 1 THEN 10 ELSE 100 END AS BIGINT) AS den FROM part""")
def time_parse(spark, sf_dir):
    """Time strings of the three forms, parsed to numerator and denominator."""
    n = F.col("p_size")
    text = F.when(n % 3 == 0, F.concat((n * 1001).cast("string"), F.lit("/30000s"))).when(n % 3 == 1, F.concat(n.cast("string"), F.lit(".5s"))).otherwise(F.concat(n.cast("string"), F.lit(".50s")))
    num, den = media.parsed_time(text)
    return table(spark, sf_dir, "part").select("p_partkey", num.alias("num"), den.alias("den"))


@query("""SELECT c_nationkey AS project, 's' || lpad(CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR), 5, '0') AS id, c_name AS name, 'audio/' || c_name || '_16k.wav' AS wav, first_value(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS header FROM customer""")
def catalog_rows(spark, sf_dir):
    """Source catalog of a project: ids in order, paths, and the header of its first row."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), F.format_string("s%05d", F.row_number().over(w)).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("audio/"), "c_name", F.lit("_16k.wav")).alias("wav"), F.first("c_mktsegment").over(w).alias("header"))


@query(f"""WITH {WORDS_SQL}, c AS (SELECT source, sent, i, CASE WHEN i % 97 = 0 THEN NULL ELSE (length(w) % 9 + 1) / 10.0 END AS conf, ("start" + "end") / 2.0 AS mid FROM words)
SELECT source, sent, CASE WHEN count(*) = count(conf) THEN round(exp(avg(ln(greatest(conf, 1e-10)))), 6) END AS conf, CAST(min(mid) AS DOUBLE) AS first_mid FROM c GROUP BY source, sent""")
def confidence_merge(spark, sf_dir):
    """Geometric mean of the word confidences of each sentence, and its first word's midpoint."""
    conf = F.when(F.col("i") % 97 != 0, (F.length("w") % 9 + 1) / 10.0)
    w = words(spark, sf_dir).select("source", "sent", conf.alias("conf"), media.midpoint(F.col("start"), F.col("end")).alias("mid"))
    # as a partial aggregate rather than an array: a sentence may be as long as its document
    mean = F.exp(F.avg(F.log(F.greatest("conf", F.lit(1e-10)))))
    return w.groupBy("source", "sent").agg(F.when(F.count("*") == F.count("conf"), F.round(mean, 6)).alias("conf"), F.min("mid").alias("first_mid"))
