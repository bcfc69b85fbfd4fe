"""Repeated passages: blocked self-join, match length, rule cascade and greedy claims.

Words are ``project, source, i, norm, ends, start, end`` with i contiguous in a project.  A passage
that starts at j is repeated at i > j of the same source within the lookback.  Blocking on the
opening word is complete because a run that opens with a tolerated mismatch matches at its second
word: candidates meet on the norm at offset 0 or at offset 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WINDOW, LEAST, MISSES, LOOKBACK_MS, AUTO_DROP_MS, MISSING = 20, 3, 5, 90_000, 20_000, 0.5


def runs(words: DataFrame, window: int = WINDOW, of: str = "norm") -> DataFrame:
    """Each word with the norms (or codes ``of``) that follow it in its source, up to the window."""
    w = Window.partitionBy("project", "source").orderBy("i").rowsBetween(0, window - 1)
    return words.withColumn("run", F.collect_list(of).over(w))


def candidates(words: DataFrame, window: int = WINDOW, least: int = LEAST, misses: int = MISSES, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """The nearest acceptable earlier start for each word: ``project, source, i, j, matches, mismatches``.

    Runs meet in windows over the words of one norm in one source, as far back as the lookback, so that
    all steps keep the words where their project lies and no run is shuffled.
    """
    # a norm's code in its source: twice the place where it stands first, and one more for content words
    code = F.min("i").over(Window.partitionBy("project", "source", "norm")) * 2 + T.content(F.col("norm")).cast("int")
    r = runs(words.select("project", "source", "i", "start", code.alias("code")), window, "code")
    keyed = r.select("project", "source", "i", "start", "run", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).withColumn("_key", F.try_element_at("run", F.col("at"))).where("_key IS NOT NULL")
    near = Window.partitionBy("project", "source", "at", "_key").orderBy("start").rangeBetween(-lookback_ms, 0)
    near = keyed.withColumn("_near", F.collect_list(F.struct(F.col("i").alias("j"), F.col("run").alias("run_j"))).over(near))
    met = near.select("project", "source", "i", "run", "at", F.inline("_near")).where("j < i").where((F.col("at") == 1) | (F.element_at("run_j", 1) != F.element_at("run", 1)))
    good = accepted(met, least, misses, lambda x: x % 2 == 1)
    best = F.max_by(F.struct("matches", "mismatches"), "j")
    return good.groupBy("project", "source", "i").agg(F.max("j").alias("j"), best.alias("m")).select("project", "source", "i", "j", "m.matches", "m.mismatches")


def accepted(met: DataFrame, least: int = LEAST, misses: int = MISSES, content=T.content) -> DataFrame:
    """The pairs ``i, j, run, run_j`` whose runs match acceptably, with ``matches`` and ``mismatches``."""
    return judged(met.where(_opening()), least, misses, content).where("ok")


def _opening():
    """Three matches with no two misses in a row show within the first four words."""
    c = [F.coalesce(F.try_element_at("run_j", F.lit(k)) == F.try_element_at("run", F.lit(k)), F.lit(False)) for k in (1, 2, 3, 4)]
    return (c[0] & (c[1] | c[2])) | (c[1] & (c[2] | c[3]))


def judged(met: DataFrame, least: int = LEAST, misses: int = MISSES, content=T.content) -> DataFrame:
    """All pairs ``i, j, run, run_j`` with ``matches``, ``mismatches`` and whether that is acceptable, ``ok``."""
    n = F.greatest(F.least(F.size("run_j"), F.size("run"), F.col("i") - F.col("j")), F.lit(0)).cast("int")
    both = F.zip_with(F.slice("run_j", F.lit(1), n), F.slice("run", F.lit(1), n), lambda x, y: F.when(x != y, "0").when(content(x), "2").otherwise("1"))
    met = met.withColumn("marks", F.when(_opening(), F.array_join(both, "")).otherwise(""))
    # a miss is tolerated only right before a match, and only so many times; the run ends at any other
    met = met.withColumn("head", F.regexp_extract("marks", "^[12]*(?:0[12]+){0," + str(misses) + "}", 0))
    met = met.withColumn("mismatches", F.length(F.regexp_replace("head", "[12]", ""))).withColumn("matches", F.length("head") - F.col("mismatches"))
    return met.withColumn("ok", (F.col("matches") >= least) & ((F.col("matches") >= 5) | F.col("head").contains("2")))


def restarts(words: DataFrame, window: int = WINDOW, least: int = LEAST, misses: int = MISSES, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """The opening run of each source against the source before, as far back as the lookback.

    ``project, source, next_source, i, n_tail, nearest``: the places compared and the last that matches
    acceptably.  A source's words travel as one row, and only its tail is cut to runs.
    """
    order = Window.partitionBy("project").orderBy("source")
    said = words.groupBy("project", "source").agg(F.array_sort(F.collect_list(F.struct("i", "start", "norm"))).alias("said"), F.max("end").alias("last_end"))
    said = said.select("project", "source", "said", "last_end", F.col("said.norm").alias("norms"))
    p = said.select("project", "source", "said", "last_end", "norms", F.lead("source").over(order).alias("next_source"), F.lead(F.element_at("said", 1)["i"]).over(order).alias("i"), F.lead(F.slice("norms", 1, window)).over(order).alias("run")).where("i IS NOT NULL")
    places = F.filter(F.sequence(F.lit(1), F.size("said")), lambda k: F.col("last_end") - F.element_at("said", k)["start"] <= lookback_ms)
    tail = F.transform(places, lambda k: F.struct(F.element_at("said", k)["i"].alias("j"), F.slice("norms", k, window).alias("run_j")))
    keys = ["project", "source", "next_source", "i"]
    met = judged(p.select(*keys, "run", F.inline(tail)), least, misses)
    return met.groupBy(*keys).agg(F.count("*").alias("n_tail"), F.max(F.when(F.col("ok"), F.col("j"))).alias("nearest"))


def guarded(found: DataFrame, words: DataFrame) -> DataFrame:
    """The rule cascade over candidates: ``action, flagged, reason`` with the features it reads."""
    span = words.select("project", F.col("i").alias("at"), "source", "norm", "ends", "start", "end")
    keyed = found.select("project", "source", "i", "j", "matches", "mismatches")
    ahead = keyed.withColumn("at", F.explode(F.sequence("j", F.col("i") + (F.col("i") - F.col("j")) + 9)))
    own = ahead.join(span.withColumnRenamed("source", "at_source").hint("merge"), ["project", "at"])  # a small file's words need not be small
    early = F.col("at") < F.col("i")
    again = (F.col("at") >= F.col("i")) & (F.col("at") < F.col("i") * 2 - F.col("j"))
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("at", "norm", "ends", "at_source")))), lambda x: x)
    made = own.groupBy("project", "source", "i", "j", "matches", "mismatches").agg(
        ordered(early).alias("e"), ordered(again).alias("l"),
        F.collect_set(F.when(early & T.content(F.col("norm")), F.col("norm"))).alias("dropped"),
        F.collect_set(F.when(~early & T.content(F.col("norm")), F.col("norm"))).alias("kept"),
        (F.max(F.when(F.col("at") == F.col("i") - 1, F.col("end"))) - F.max(F.when(F.col("at") == F.col("j"), F.col("start")))).alias("duration_ms"),
    )
    inner = lambda x: F.exists(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda w: w["ends"])
    norms = lambda x: F.transform(x, lambda w: w["norm"])
    exact = (F.size("e") == F.size("l")) & F.try_element_at("e", F.lit(-1))["ends"] & F.try_element_at("l", F.lit(-1))["ends"] & ~inner("e") & ~inner("l") & (norms("e") == norms("l")) & F.forall("l", lambda w: w["at_source"] == F.try_element_at("l", F.lit(1))["at_source"])
    missing = F.when(F.size("dropped") > 0, F.size(F.array_except("dropped", "kept")) / F.size("dropped")).otherwise(0.0)
    done = F.exists("e", lambda w: w["ends"])
    made = made.withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("missing", missing).withColumn("done", done)
    reason = F.when(F.col("exact"), F.lit(None)).when(F.col("done"), "complete_sentence").when(F.col("duration_ms") > AUTO_DROP_MS, "long_segment").when(F.col("missing") > MISSING, "retake_missing_content")
    action = F.when(F.col("exact"), "drop").when(F.col("done") | (F.col("duration_ms") > AUTO_DROP_MS), "keep").otherwise("drop")
    return made.select("project", "source", "i", "j", "matches", "mismatches", "duration_ms", "exact", F.col("missing"), action.alias("action"), reason.alias("reason"))


def claims(found: DataFrame) -> DataFrame:
    """Greedy left-to-right claims per source: accept a candidate whose span starts after the last accepted end.

    Only candidates (a few per source) reach a task; accepting one claims ``[j, i - 1]``.
    """

    def claim(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        free, keep = -1, []
        for i, j in zip(rows["i"], rows["j"]):
            keep.append(j >= free)
            free = i if keep[-1] else free
        out = rows[keep].copy()
        out["id"] = [f"d{n + 1:03d}" for n in range(len(out))]
        return out

    return found.groupBy("project", "source").applyInPandas(claim, ", ".join(f"`{n}` {t}" for n, t in found.dtypes) + ", id string")
