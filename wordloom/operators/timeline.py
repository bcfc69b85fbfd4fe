"""Kept words to time ranges: grouping, cut points, frames, merging and markers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from . import islands


def group(words: DataFrame, max_gap_ms: int = 400, dropped: str | None = None) -> DataFrame:
    """Ranges of kept words: a new one where the pause is over ``max_gap_ms`` or a dropped word lies between."""
    kept = words if dropped is None else words.where(~F.col(dropped))
    w = kept.withColumn("_end", islands.before("end", ["source"], ["i"])).withColumn("_i", islands.before("i", ["source"], ["i"]))
    breaks = (F.col("start") - F.col("_end") > max_gap_ms) | (F.col("i") - F.col("_i") > 1)
    w = islands.number(w, ["source"], ["i"], breaks, "range_no")
    return w.groupBy("source", "range_no").agg(F.min("i").alias("first_word"), F.max("i").alias("last_word"), F.min("start").alias("in_ms"), F.max("end").alias("out_ms"), F.count("*").alias("n_words"))


def split_on_zones(words: DataFrame, zones: DataFrame, head_ms: int = 80, tail_ms: int = 120) -> DataFrame:
    """Words ``source, i, start, end, range_no`` with ranges split where a zone ``source, zs, ze`` can be left out.

    A zone parts two words in a row of a range if no midpoint is in it and both sides can clear it:
    the word before ends at least ``tail_ms`` before the zone, the word behind starts at least
    ``head_ms`` after it.  For each pause the earliest end of the zones that start late enough
    decides, by one window over words and zones, latest first.  ``range_no`` is numbered anew from 0.
    """
    order = Window.partitionBy("source").orderBy("i")
    before = lambda c: F.when(F.lag("range_no").over(order) == F.col("range_no"), F.lag(c).over(order))
    w = words.select("source", "i", "start", "end", "range_no", before("start").alias("_start"), before("end").alias("_end"))
    at = F.greatest(F.col("_end") + tail_ms, F.floor((F.col("_start") + F.col("_end")) / 2) + 1)
    w = w.select("source", "i", "start", "end", "range_no", F.when(F.col("_end").isNotNull(), at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_ze"))
    both = w.unionByName(zones.select("source", F.col("zs").cast("long").alias("_at"), F.lit(1).alias("_side"), F.col("ze").cast("long").alias("_ze")), allowMissingColumns=True)
    late = Window.partitionBy("source").orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    free = F.least(F.col("start") - head_ms, F.floor((F.col("start") + F.col("end") - 1) / 2))
    parted = both.withColumn("_parted", F.col("_at").isNotNull() & F.coalesce(F.min("_ze").over(late) <= free, F.lit(False))).where("_side = 0")
    breaks = F.col("_parted") | (F.lag("range_no").over(order) != F.col("range_no"))
    return islands.number(parted, ["source"], ["i"], breaks, "_piece").select("source", "i", "start", "end", F.col("_piece").alias("range_no"))


def cut_points(ranges: DataFrame, words: DataFrame, head_ms: int = 80, tail_ms: int = 120) -> DataFrame:
    """Pads each range, but not into the words before and after it (kept or dropped)."""
    order = Window.partitionBy("source").orderBy("i")
    w = words.select("source", "i", F.lag("end").over(order).alias("_before"), F.lead("start").over(order).alias("_after"))
    out = ranges.join(w.select("source", F.col("i").alias("first_word"), "_before"), ["source", "first_word"]).join(w.select("source", F.col("i").alias("last_word"), "_after"), ["source", "last_word"])
    cut_in = F.greatest(F.col("in_ms") - head_ms, F.coalesce("_before", F.lit(0)))
    cut_out = F.least(F.col("out_ms") + tail_ms, F.coalesce("_after", F.col("out_ms") + tail_ms))
    return out.select("source", "range_no", "first_word", "last_word", cut_in.alias("cut_in"), cut_out.alias("cut_out"))


def cut_ranges(words: DataFrame, max_gap_ms: int = 400, head_ms: int = 80, tail_ms: int = 120) -> DataFrame:
    """``group`` and ``cut_points`` of words none of which is dropped, in one pass over them."""
    order = Window.partitionBy("source").orderBy("i")
    w = words.select("source", "i", "start", "end", F.lag("end").over(order).alias("_before"), F.lead("start").over(order).alias("_after"))
    w = islands.number(w, ["source"], ["i"], F.col("start") - F.col("_before") > max_gap_ms, "range_no")
    r = w.groupBy("source", "range_no").agg(
        F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word"), F.min("start").alias("_in"), F.max("end").alias("_out"),
        F.min_by("_before", "i").alias("_before"), F.max_by("_after", "i").alias("_after"),
    )
    cut_in, cut_out = F.greatest(F.col("_in") - head_ms, F.coalesce("_before", F.lit(0))), F.col("_out") + tail_ms
    return r.select("source", "range_no", "first_word", "last_word", cut_in.alias("cut_in"), F.least(cut_out, F.coalesce("_after", cut_out)).alias("cut_out"))


def framed(ranges: DataFrame, num: int, den: int) -> DataFrame:
    first, last = timing.frame_range(F.col("cut_in"), F.col("cut_out"), F.lit(num), F.lit(den))
    return ranges.withColumn("in_frame", first).withColumn("out_frame", last)


def merge_touching(ranges: DataFrame, most: int = 1) -> DataFrame:
    """Joins ranges whose frame gap is at most ``most``."""
    r = ranges.withColumn("_out", islands.before("out_frame", ["source"], ["in_frame"]))
    r = islands.number(r, ["source"], ["in_frame"], F.col("in_frame") - F.col("_out") > most, "piece")
    return r.groupBy("source", "piece").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("in_frame").alias("in_frame"), F.max("out_frame").alias("out_frame"), F.count("*").alias("merged"))


def remove_tiny(ranges: DataFrame, least: int = 6, max_gap: int = 12) -> DataFrame:
    """Ranges under ``least`` frames join the one before if near, else the one behind, else go.

    One left-to-right pass per source, since a range that grew is looked at again.  A source's ranges
    reach the pass as one row, so a batch holds many sources.
    """

    def compact(todo: list[dict]) -> list[list[int]]:
        todo, done = [[r["first_word"], r["last_word"], r["in_frame"], r["out_frame"]] for r in todo], []
        for at, r in enumerate(todo):
            if r[3] - r[2] >= least:
                done.append(r)
            elif done and r[2] - done[-1][3] <= max_gap:
                done[-1][1], done[-1][3] = r[1], r[3]
            elif at + 1 < len(todo) and todo[at + 1][2] - r[3] <= max_gap:
                todo[at + 1][0], todo[at + 1][2] = r[0], r[2]
        return done

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = [(source, *r) for source, every in zip(part["source"].to_pylist(), part["every"].to_pylist()) for r in compact(every)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

    names = ["source", "first_word", "last_word", "in_frame", "out_frame"]
    every = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("in_frame", "out_frame", "first_word", "last_word")])))
    held = ranges.groupBy("source").agg(every.alias("every"))
    return held.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def attach(markers: DataFrame, ranges: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Markers ``source, at_word`` to the range that holds the word, else the first later one, else the last.

    Other columns of the markers stay; ``carried`` are columns of the range that come along.
    """
    # latest first: a frame that grows is read once, one that shrinks is read again for every row
    later = Window.partitionBy("source").orderBy(F.col("_at").desc(), F.col("_side").desc(), F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, 0)
    r = ranges.select("source", F.col("last_word").alias("_at"), F.lit(1).alias("_side"), F.struct("range_no", *carried).alias("_range"))
    m = markers.withColumnRenamed("at_word", "_at").withColumn("_side", F.lit(0))
    both = m.unionByName(r, allowMissingColumns=True)
    everything = Window.partitionBy("source")
    to = F.coalesce(F.last("_range", ignorenulls=True).over(later), F.max("_range").over(everything))
    rest = [c for c in markers.columns if c not in ("source", "at_word")]
    return both.withColumn("_to", to).where("_side = 0").select("source", F.col("_at").alias("at_word"), *rest, "_to.range_no", *[F.col(f"_to.{c}").alias(c) for c in carried])
