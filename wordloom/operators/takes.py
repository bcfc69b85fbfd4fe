"""Takes of script sentences: validity, choice, alternates, suppression and monotone choice."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(takes: DataFrame, words: DataFrame) -> DataFrame:
    """``takes(project, sentence, first_word, last_word, score)`` whose ends exist, are in order and lie in one source."""
    at = words.select("project", F.col("i").alias("first_word"), F.col("source").alias("_a"))
    to = words.select("project", F.col("i").alias("last_word"), F.col("source").alias("_b"))
    met = takes.where("first_word <= last_word").join(at, ["project", "first_word"]).join(to, ["project", "last_word"])
    return met.where(F.col("_a") == F.col("_b")).withColumnRenamed("_a", "source").drop("_b")


def chosen(takes: DataFrame, prefer: str = "best") -> DataFrame:
    """One take a sentence: the best score (or the last), ties to the later first, then the later last word."""
    rank = F.struct("score", "first_word", "last_word") if prefer == "best" else F.struct("first_word", "score", "last_word")
    whole = F.struct(*[c for c in takes.columns if c not in ("project", "sentence")])
    return takes.groupBy("project", "sentence").agg(F.max_by(whole, rank).alias("t")).select("project", "sentence", "t.*")


def _sorted_runs(batches, keys: int):
    """Sorted record batches to one list of rows (tuples) a key, the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _mapped(takes: DataFrame, keys: list[str], order: list, pick) -> DataFrame:
    """``pick(rows of a key)`` on every key's rows in order; a partition holds whole keys and streams through them."""
    columns = ["project", "sentence", "first_word", "last_word", "score"]
    schema = takes.select(*columns).schema
    names = [f"{f.name} {f.dataType.simpleString()}" for f in schema]

    def run(batches):
        shape = None

        def peek():
            nonlocal shape
            for batch in batches:
                shape = batch.schema
                yield batch

        out: list[tuple] = []
        for rows in _sorted_runs(peek(), len(keys)):
            out += pick(rows)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return takes.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join(names))


def suppressed(takes: DataFrame) -> DataFrame:
    """Of each sentence's takes the greedy choice that do not overlap, by score, then by the later first word."""

    def pick(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in rows:
            if all(row[3] < other[2] or other[3] < row[2] for other in kept):
                kept.append(row)
        return kept

    return _mapped(takes, ["project", "sentence"], [F.desc("score"), F.desc("first_word"), F.desc("last_word")], pick)


def monotone(takes: DataFrame) -> DataFrame:
    """At most one take a sentence, in sentence order and without overlap, with the largest sum of scores.

    Ties cover the earlier sentences, then take later first words.  One pass of dynamic programming a
    project, over its takes in sentence order.
    """

    def pick(rows: list[tuple]) -> list[tuple]:
        best: list[tuple] = []  # of the choices that end with a take: score, sentences, first words, the take, what comes before
        for row in rows:
            top = max((b for b in best if b[3][1] < row[1] and b[3][3] < row[2]), key=lambda b: b[:3], default=(0.0, (), (), None, None))
            best.append((top[0] + row[4], (*top[1], -row[1]), (*top[2], row[2]), row, top if top[3] else None))
        at, out = max(best, key=lambda b: b[:3]), []
        while at:
            out.append(at[3])
            at = at[4]
        return out[::-1]

    return _mapped(takes, ["project"], ["sentence", "first_word", "last_word"], pick)


def alternates(takes: DataFrame, picked: DataFrame, min_gap: float = 5.0, drop_later: bool = True) -> DataFrame:
    """Decisions on takes other than the chosen one that overlap no other take of the project.

    Dropped, flagged ``script_close_call`` where the chosen score leads by less than ``min_gap``;
    later alternates are kept and flagged where ``drop_later`` is false.
    """
    all_ = takes.select("project", F.col("first_word").alias("a"), F.col("last_word").alias("b"))
    # overlap with a neighbour in word order shows as a start at or before the largest end so far, or an end at or after the next start
    order = Window.partitionBy("project").orderBy("a", "b")
    lone = all_.withColumn("_end", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_next", F.lead("a").over(order))
    lone = lone.where(F.coalesce(F.col("a") > F.col("_end"), F.lit(True)) & F.coalesce(F.col("b") < F.col("_next"), F.lit(True))).select("project", F.col("a").alias("first_word"), F.col("b").alias("last_word"))
    best = picked.select("project", "sentence", F.col("first_word").alias("_first"), F.col("score").alias("_score"))
    out = takes.join(best, ["project", "sentence"]).where("first_word <> _first").join(lone, ["project", "first_word", "last_word"])
    later = (F.col("first_word") > F.col("_first")) & F.lit(not drop_later)
    close = F.col("_score") - F.col("score") < min_gap
    return out.select("project", "sentence", "first_word", "last_word", F.when(later, "keep").otherwise("drop").alias("action"), F.when(later, "script_later_take").when(close, "script_close_call").alias("flag_reason"))
