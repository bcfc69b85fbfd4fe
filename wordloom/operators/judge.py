"""Verdicts on flagged decisions: eligibility, validation, application, context (verdicts arrive as a table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The reasons that a judge is asked about, and the choices it has.
REASONS = ["long_segment", "retake_missing_content"]
CHOICES = ["A", "B", "both"]
MIN_CONFIDENCE = 0.7
_REPLY = "choice string, confidence string, reason string"


def eligible(flagged: Column, reason: Column) -> Column:
    return flagged & reason.isin(REASONS)


def verdict(reply: Column) -> Column:
    """A JSON reply as ``choice, confidence, reason``; null unless the choice is known, the confidence a number from 0 to 1 and the reason at most 300 characters."""
    r = F.from_json(reply, _REPLY)
    confidence = F.when(r["confidence"].rlike(r"^[0-9.]+([eE][-+]?[0-9]+)?$"), r["confidence"].try_cast("double"))
    sound = r["choice"].isin(CHOICES) & confidence.between(0, 1) & (F.length(F.coalesce(r["reason"], F.lit(""))) <= 300)
    return F.when(sound, F.struct(r["choice"].alias("choice"), confidence.alias("confidence"), r["reason"].alias("reason")))


def applied(decisions: DataFrame, replies: DataFrame, reachable: Column | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """``decisions(id, action, flagged, flag_reason)`` after the verdicts of ``replies(id, reply)``.

    Without a sound verdict a decision stays.  Little confidence keeps both and flags; ``B`` drops and
    unflags; ``both`` keeps and unflags; ``A`` keeps and flags ``judge_prefers_first_take``.  ``reachable``
    false anywhere leaves all as they are.
    """
    v = verdict(F.col("reply"))
    d = decisions.join(replies, "id", "left").withColumn("_v", F.when(eligible(F.col("flagged"), F.col("flag_reason")) & (F.lit(True) if reachable is None else reachable), v))
    low, choice = F.col("_v.confidence") < least, F.col("_v.choice")
    action = F.when(F.col("_v").isNull(), F.col("action")).when(low, "keep").when(choice == "B", "drop").otherwise("keep")
    flagged = F.when(F.col("_v").isNull(), F.col("flagged")).when(low | (choice == "A"), True).otherwise(False)
    reason = F.when(F.col("_v").isNull() | low, F.col("flag_reason")).when(choice == "A", "judge_prefers_first_take")
    return d.select(*[c for c in decisions.columns if c not in ("action", "flagged", "flag_reason")], action.alias("action"), flagged.alias("flagged"), reason.alias("flag_reason"))


def contexts(words: DataFrame, spans: DataFrame) -> DataFrame:
    """``source, id, before, a, b, after`` for ``spans(source, id, sent)``: sentence-wise text around a span.

    ``before``: the two sentences ahead; ``a``: the span's; ``b``: the one that follows it (the later
    take), ``after``: the next.
    """
    # words and spans meet in one aggregate by sentence: no join, and no shuffle where both lie by source
    both = words.select("source", "sent", "i", "w").unionByName(spans.select("source", "sent", "id"), allowMissingColumns=True)
    own = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "w"))))
    said = both.groupBy("source", "sent").agg(F.array_join(F.transform(own, lambda x: x["w"]), " ").alias("text"), F.collect_list("id").alias("ids"), F.count("i").alias("n")).where("n > 0")
    w = Window.partitionBy("source").orderBy("sent")
    near = said.select("source", "ids", F.concat_ws(" ", F.lag("text", 2).over(w), F.lag("text", 1).over(w)).alias("before"), F.col("text").alias("a"), F.lead("text", 1).over(w).alias("b"), F.lead("text", 2).over(w).alias("after"))
    return near.select("source", F.explode("ids").alias("id"), "before", "a", "b", "after")
