"""Edit lists: ranges to XML, and XML back to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, timing

_CLIP = "array<struct<_ref:string,_offset:string,_start:string,_duration:string,_name:string>>"
_SHAPE = f"resources struct<asset:array<struct<_id:string,_src:string,_start:string>>>, library struct<event:struct<project:array<struct<_name:string,sequence:struct<spine:struct<`asset-clip`:{_CLIP},gap:{_CLIP},title:{_CLIP}>>>>>>"


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _element(tag: str, **attributes: Column) -> Column:
    parts = [p for name, value in attributes.items() for p in (F.lit(f' {name}="'), _escaped(value), F.lit('"'))]
    return F.concat(F.lit(f"<{tag}"), *parts, F.lit("/>"))


def written(ranges: DataFrame, assets: DataFrame, num: int, den: int) -> DataFrame:
    """One document a project: ``project, xml``.

    ``ranges(project, n, source, in_frame, out_frame)`` are laid end to end in order of ``n``;
    ``assets(project, source, path, start_frames)``.  Times are reduced fractions of a second.
    """
    time = lambda frames: timing.rational(frames.cast("long"), F.lit(num), F.lit(den))
    from pyspark.sql import Window

    before = Window.partitionBy("project").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    r = ranges.join(assets.select("project", "source", "start_frames"), ["project", "source"]).withColumn("frames", F.col("out_frame") - F.col("in_frame"))
    r = r.withColumn("offset", F.coalesce(F.sum("frames").over(before), F.lit(0)))
    clip = _element("asset-clip", ref=F.col("source").cast("string"), offset=time(F.col("offset")), start=time(F.col("start_frames") + F.col("in_frame")), duration=time(F.col("frames")), name=F.format_string("r%03d", F.col("n")))
    spine = r.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", clip.alias("x")))), lambda c: c["x"]), "").alias("spine"))  # a document is one row
    one = _element("asset", id=F.col("source").cast("string"), src=media.file_uri(F.col("path")), start=time(F.col("start_frames")))
    held = assets.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("assets"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE fcpxml><fcpxml version="1.11"><resources><format id="f" frameDuration="{den}/{num}s"/>'
    project = F.concat(F.lit('</resources><library><event><project name="'), _escaped(F.col("project").cast("string")), F.lit('"><sequence format="f"><spine>'))
    xml = F.concat(F.lit(head), "assets", project, F.coalesce("spine", F.lit("")), F.lit("</spine></sequence></project></event></library></fcpxml>"))
    return held.join(spine, "project", "left").select("project", xml.alias("xml"))


def parsed(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """``documents``' other columns with ``n, name, in_num, in_den, out_num, out_den`` of each clip of the first project's spine.

    In- and out-points are seconds from the start of the asset, as fractions.  Gaps and titles give no row.
    """
    keep = [c for c in documents.columns if c != xml]
    d = documents.select(*keep, F.from_xml(F.col(xml), _SHAPE, {"mode": "FAILFAST"}).alias("d"))
    names = F.map_from_entries(F.transform("d.resources.asset", lambda a: F.struct(a["_id"], F.struct(a["_src"].alias("src"), a["_start"].alias("start")))))
    clips = F.try_element_at("d.library.event.project", F.lit(1))["sequence"]["spine"]["asset-clip"]
    rows = d.select(*keep, names.alias("assets"), F.posexplode(clips).alias("n", "c"))
    rows = rows.withColumn("a", F.element_at("assets", F.col("c._ref")))
    (sn, sd), (an, ad), (dn, dd) = (media.parsed_time(F.coalesce(c, F.lit("0s"))) for c in (F.col("c._start"), F.col("a.start"), F.col("c._duration")))
    in_num, in_den = sn * ad - an * sd, sd * ad
    return rows.select(*keep, "n", media.uri_name(F.col("a.src")).alias("name"), in_num.alias("in_num"), in_den.alias("in_den"), (in_num * dd + dn * in_den).alias("out_num"), (in_den * dd).alias("out_den"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The spans of every edit list under ``path``: one document a file."""
    return parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml")))
