"""Scalar functions on media records: rates, durations, names, formats and time strings (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample-rate tokens, and format names by size and frame duration.
RATE_TOKENS = {32000: "32k", 44100: "44.1k", 48000: "48k", 88200: "88.2k", 96000: "96k", 176400: "176.4k", 192000: "192k"}
PROBE = "streams array<struct<codec_type:string,width:long,height:long,r_frame_rate:string,avg_frame_rate:string,channels:long,sample_rate:string,duration_ts:long,time_base:string,duration:string,tags:struct<timecode:string>>>, format struct<duration:string,tags:struct<timecode:string>>"


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def duration_frames(ms: Column, num: Column, den: Column) -> Column:
    """Whole frames in a duration, on integers."""
    return F.call_function("div", ms * num, den * 1000)


def varies(num: Column, den: Column, avg_num: Column, avg_den: Column) -> Column:
    """Whether the average rate differs from the nominal one, by cross products."""
    return num * avg_den != avg_num * den


def confidence(values: Column) -> Column:
    """Geometric mean of an array; null where one is null or there is none."""
    total = F.aggregate(values, F.lit(0.0), lambda a, c: a + F.log(F.greatest(c, F.lit(1e-10))))
    whole = F.forall(values, lambda c: c.isNotNull()) & (F.size(values) > 0)
    return F.when(whole, F.exp(total / F.size(values)))


def layout(channels: Column) -> Column:
    return F.when(channels == 1, "mono").when(channels == 2, "stereo").when(channels > 2, "surround").otherwise(F.raise_error(F.lit("no audio channel")).cast("string"))


def rate_token(hertz: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in RATE_TOKENS.items() for x in pair])
    return F.coalesce(F.element_at(known, hertz.cast("int")), F.raise_error(F.concat(F.lit("unknown audio rate: "), hertz.cast("string"))).cast("string"))


def tick_duration(ticks: Column, base_num: Column, base_den: Column, seconds: Column) -> Column:
    """Seconds from ticks and time base, else from the decimal string."""
    return F.coalesce(ticks * base_num / base_den, seconds.cast("double"))


def file_uri(path: Column) -> Column:
    """``file://`` with every path segment percent-encoded."""
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/"))


def uri_name(uri: Column) -> Column:
    """The decoded file name of a URI; a literal plus sign stays."""
    return F.url_decode(F.replace(F.substring_index(F.regexp_replace(uri, r"[?#].*$", ""), "/", -1), F.lit("+"), F.lit("%2B")))


def filled(template: Column, project: Column) -> Column:
    return F.replace(template, F.lit("{project}"), project)


def reject_kind(id_: Column) -> Column:
    return F.when(id_.startswith("f"), "filler").otherwise("retake")


def parsed_time(text: Column) -> tuple[Column, Column]:
    """``0s``, ``12.5s`` or ``a/bs`` as numerator and denominator (longs); anything else raises."""
    ratio = F.regexp_extract(text, r"^(\d+)/(\d+)s$", 0) != ""
    whole, part = F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?s$", 1), F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?s$", 2)
    scale = F.pow(F.lit(10), F.length(part)).cast("long")
    bad = F.raise_error(F.concat(F.lit("not a time: "), text)).cast("long")
    num = F.when(ratio, F.regexp_extract(text, r"^(\d+)/", 1).cast("long")).when(whole != "", F.concat(whole, part).cast("long")).otherwise(bad)
    return num, F.when(ratio, F.regexp_extract(text, r"/(\d+)s$", 1).cast("long")).otherwise(scale)


def probed(json: Column) -> Column:
    """A media probe's JSON as one record: first video and first audio stream, with the fallback chains."""
    p = F.from_json(json, PROBE, {"mode": "FAILFAST"})
    first = lambda kind: F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(1))
    video, audio, data = first("video"), first("audio"), first("data")
    half = lambda rate, k: F.split(rate, "/")[k].cast("long")
    seconds = tick_duration(video["duration_ts"], half(video["time_base"], 0), half(video["time_base"], 1), F.coalesce(video["duration"], p["format"]["duration"]))
    code = F.coalesce(video["tags"]["timecode"], data["tags"]["timecode"], p["format"]["tags"]["timecode"], F.lit("00:00:00:00"))
    return F.struct(
        video["width"].alias("width"), video["height"].alias("height"), half(video["r_frame_rate"], 0).alias("num"), half(video["r_frame_rate"], 1).alias("den"),
        varies(half(video["r_frame_rate"], 0), half(video["r_frame_rate"], 1), half(video["avg_frame_rate"], 0), half(video["avg_frame_rate"], 1)).alias("varies"),
        audio["channels"].alias("channels"), audio["sample_rate"].cast("long").alias("rate"), code.alias("timecode"), seconds.alias("seconds"),
    )
