"""Filler words: sole-word protection, runs and sentence openers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, islands


# Hesitation sounds.
HUMS = ["um", "uh", "uhm", "umm", "erm", "hmm", "mhm", "mm", "ah", "eh", "er"]


def runs(words: DataFrame, listed: list[str] = HUMS, most_ms: int = 1500) -> DataFrame:
    """Maximal runs of filler words among kept words, none of them a sentence's only word.

    ``source, first_word, last_word, n, duration_ms, action``; a run longer than ``most_ms`` is kept.
    """
    sole = F.count("*").over(Window.partitionBy("source", "sent")) == 1
    w = words.withColumn("filler", F.col("norm").isin(listed) & ~sole)
    order = Window.partitionBy("source").orderBy("i")
    w = w.withColumn("_run", F.row_number().over(order)).where("filler")
    w = w.withColumn("_run", F.col("_run") - F.row_number().over(order))
    made = w.groupBy("source", "_run").agg(F.min("i").alias("first_word"), F.max("i").alias("last_word"), F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("duration_ms"))
    return made.drop("_run").withColumn("action", F.when(F.col("duration_ms") > most_ms, "keep").otherwise("drop"))


def openers(words: DataFrame, listed: list[str]) -> DataFrame:
    """Listed words that open a sentence (only fillers before them) with another word of it behind."""
    order = Window.partitionBy("source", "sent").orderBy("i")
    w = words.withColumn("filler", F.col("norm").isin(HUMS))
    clear = F.coalesce(F.bool_and("filler").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    w = w.withColumn("_clear", clear).withColumn("_next", F.lead("i").over(order))
    return w.where(F.col("_clear") & F.col("_next").isNotNull() & F.col("norm").isin(listed)).select("source", "sent", "i", "norm")


def phrases(words: DataFrame, phrase: list[str]) -> DataFrame:
    """Places where the words of a phrase stand in a row in one source."""
    order = Window.partitionBy("source").orderBy("i")
    hit = F.col("norm") == phrase[0]
    for k, word in enumerate(phrase[1:], 1):
        hit = hit & (F.lead("norm", k).over(order) == word)
    return words.withColumn("_hit", hit).where("_hit").select("source", F.col("i").alias("first_word"), (F.col("i") + len(phrase) - 1).alias("last_word"))


def spans(words: DataFrame, listed: list[str], listed_phrases: list[list[str]], most_ms: int = 1500, dropped: str | None = None) -> DataFrame:
    """Filler phrases and runs of kept words, left to right and without overlaps in one source.

    At each word the longest listed phrase goes first, then the run of listed words; dropped words
    between do not break either, and a sentence's only kept word is part of none.  ``source,
    first_word, last_word, kind, duration_ms, action``; a span longer than ``most_ms`` is kept.

    A word can open a run only where the run starts or a phrase ends before it, so a run is one
    candidate whatever its length.  Candidates that overlap form islands; the greedy choice is made
    inside each of them.
    """
    order, falling = Window.partitionBy("source").orderBy("i"), Window.partitionBy("source").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w = words if dropped is None else words.where(~F.col(dropped))
    w = w.withColumn("_sole", F.count("*").over(Window.partitionBy("source", "sent")) == 1).withColumn("_k", F.row_number().over(order))
    w = w.withColumn("_norm", F.when(~F.col("_sole"), F.col("norm"))).withColumn("_filler", F.coalesce(F.col("_norm").isin(listed), F.lit(False)))
    size = F.lit(None).cast("int")
    for phrase in sorted(listed_phrases, key=len):  # the longest is asked last, so first in effect
        hit = F.col("_norm") == phrase[0]
        for n, word in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.lead("_norm", n).over(order) == word, F.lit(False))
        size = F.when(hit, len(phrase)).otherwise(size)
    place = lambda k, i, end: F.struct(k.alias("to"), i.alias("last_word"), end.alias("end"))
    w = w.withColumn("_size", size).withColumn("_before", place(F.col("_k") - 1, F.lag("i").over(order), F.lag("end").over(order)))
    # a run ends before the next other word, else with the source
    w = w.withColumn("_stop", F.coalesce(F.last(F.when(~F.col("_filler"), F.col("_before")), ignorenulls=True).over(falling), F.first(place(F.col("_k"), F.col("i"), F.col("end"))).over(falling)))
    opens = ~F.coalesce(F.lag("_filler").over(order), F.lit(False))
    for n in sorted({len(phrase) for phrase in listed_phrases}):
        opens = opens | F.coalesce(F.lag("_size", n).over(order) == n, F.lit(False))
    phrase_end = F.lit(None)
    for n in {len(phrase) for phrase in listed_phrases}:
        phrase_end = F.when(F.col("_size") == n, place(F.col("_k") + n - 1, F.lead("i", n - 1).over(order), F.lead("end", n - 1).over(order))).otherwise(phrase_end)
    w = w.withColumn("_last", F.when(F.col("_size").isNotNull(), phrase_end).when(F.col("_filler") & opens, F.col("_stop")))
    found = w.where("_last IS NOT NULL").select("source", "_k", F.col("_last.to").alias("_to"), F.when(F.col("_size").isNotNull(), "phrase").otherwise("run").alias("kind"), F.col("i").alias("first_word"), "_last.last_word", "start", "_last.end")
    by_start = Window.partitionBy("source").orderBy("_k")
    found = islands.number(found.withColumn("_reach", F.max("_to").over(by_start.rowsBetween(Window.unboundedPreceding, -1))), ["source"], ["_k"], F.col("_k") > F.col("_reach"))
    every = F.array_sort(F.collect_list(F.struct("_k", "_to", "kind", "first_word", "last_word", "start", "end")))
    none = F.filter("every", lambda c: F.lit(False))
    picked = F.aggregate("every", F.struct(F.lit(0).alias("end"), none.alias("out")), lambda a, c: F.when(c["_k"] > a["end"], F.struct(c["_to"].alias("end"), F.array_append(a["out"], c).alias("out"))).otherwise(a), lambda a: a["out"])
    out = found.groupBy("source", "island").agg(every.alias("every")).select("source", F.inline(picked))
    out = out.withColumn("duration_ms", F.col("end") - F.col("start"))
    return out.select("source", "first_word", "last_word", "kind", "duration_ms", F.when(F.col("duration_ms") > most_ms, "keep").otherwise("drop").alias("action"))


def marked(words: DataFrame, spans: DataFrame, name: str = "dropped") -> DataFrame:
    """Words with a column ``name``: whether a dropped span ``source, first_word, last_word`` holds them."""
    return intervals.held(words, spans, ["source"], "i", "first_word", "last_word", name, closed=True)


def kept(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words outside every dropped span ``source, first_word, last_word``."""
    return marked(words, spans, "_dropped").where("NOT _dropped").drop("_dropped")
