"""Markdown scripts to chapters and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_FENCE = r"^ {0,3}(`{3,}|~{3,})"
_HEAD = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"


def lines(scripts: DataFrame, text: Column) -> DataFrame:
    """``script, line, text`` outside front matter, comments and fenced code (a fence closes with its own mark)."""
    body = T.strip_comments(T.strip_front_matter(text))
    split = scripts.select("script", F.split(body, "\n").alias("all"))
    mark = lambda s: F.regexp_extract(s, _FENCE, 1)
    # the open fence's mark while walking the lines; a line stays if no fence is open before or at it
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc, s):
        here, closes = mark(s), (acc["open"] != "") & s.rlike(r"^ {0,3}(`+|~+)[ \t]*$") & F.startswith(mark(s), acc["open"])
        now = F.when(closes, "").when(acc["open"] != "", acc["open"]).otherwise(here)
        return F.struct(now.alias("open"), F.array_append(acc["keep"], (acc["open"] == "") & (here == "")).alias("keep"))

    kept = F.aggregate("all", state, step, lambda acc: acc["keep"])
    flat = split.select("script", F.posexplode(F.arrays_zip(F.col("all").alias("text"), kept.alias("keep"))).alias("line", "l"))
    return flat.where("l.keep").select("script", "line", F.col("l.text").alias("text"))


def parsed(scripts: DataFrame, text: Column, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``script, chapter, sentence, text``: sentences in order, with the title of their chapter (null before one).

    Headings of ``levels`` open chapters; others vanish and leave the chapter open.  Blank lines and
    headings end paragraphs; a paragraph's lines are joined by a space, split into sentences and
    stripped of inline markup; sentences that become empty are dropped.
    """
    order = Window.partitionBy("script").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hashes, title = F.length(F.regexp_extract("text", _HEAD, 1)), F.regexp_extract("text", _HEAD, 2)
    own = lines(scripts, text).withColumn("_level", hashes).withColumn("_title", T.strip_inline(title))
    ends = (F.col("_level") > 0) | (F.trim("text") == "")
    own = own.withColumn("chapter", F.last(F.when(F.col("_level").isin(*levels), F.col("_title")), ignorenulls=True).over(upto)).withColumn("_par", F.sum(ends.cast("long")).over(upto))
    paragraph = own.where(~ends).groupBy("script", "_par").agg(F.first("chapter").alias("chapter"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    said = paragraph.select("script", "chapter", "_par", F.posexplode(T.sentences(F.col("t"))).alias("_at", "text"))
    said = said.withColumn("text", F.trim(T.strip_inline(F.col("text")))).where("text <> ''")
    return said.select("script", "chapter", F.row_number().over(Window.partitionBy("script").orderBy("_par", "_at")).cast("long").alias("sentence"), "text")
