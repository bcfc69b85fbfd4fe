"""Embedding near-dedup by spherical-cap filters.

Filter directions are a structured random product code: the dimensions fall into two blocks, each
with K random unit code words, and every pair of code words (scaled) is one of K*K directions.  A
vector is list-decoded to all directions whose inner product with it exceeds the cap threshold; two
vectors at the target cosine share about ``common`` of them, so practically every such pair meets.
The threshold makes buckets of about ``bucket`` spread-out vectors, whatever their number; K
follows from it, so both grow with the table and neither is a cap.  Decoding sorts one block's K
scores and takes prefixes of them, so it costs the sort and the filters found.

Vectors meet twice.  First only ids and 128 sign bits go to the filters: a vector stays in a filter
if another's bits are within ``FAR`` of its own (a pair at the target is beyond with probability
3e-7).  What stays is verified: vectors join their filters, cosines are taken in double precision, and
a pair that meets several times counts in its smallest common filter only.

Equal vectors are one class (their smallest id and how many there are).  A bucket larger than
``block`` skips the first meeting, is cut into blocks and every pair of blocks is a group of its
own, so no task holds more than two blocks.  A group returns sums and a spanning forest, never its
pairs.  That counts every link of a vector, which for a set of g different near copies is g * g
products and g rows.

Null or zero vectors and those with null or non-finite components link with nothing.  Vectors of
different dimension never link.  An empty table gives no rows; repeated rows count one each; rows
with a null id count as vectors and keep it.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import erfc, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, partitions, release, runs, stored, table

COSINE = 0.9
COMMON = 14.0  #: expected number of common filters of a pair exactly at the target cosine
BUCKET = 32
BLOCK = 1500
WIDE = 1024  #: filters looked at together when a pair's smallest common one is sought
FAR = 38  #: of 128 sign bits, those in which a verified pair may differ (18.4 expected at cosine 0.9, deviation 4)
BROADCAST = 100_000  #: most filters above ``block`` whose names are broadcast


def parameters(rows: int, cosine: float = COSINE, bucket: int = BUCKET, common: float = COMMON) -> tuple[float, int]:
    """Cap threshold in standard deviations and code words a block for ``rows`` vectors."""
    share = min(0.02, bucket / max(1, rows))
    low, high = 0.0, 12.0
    for _ in range(80):
        t = (low + high) / 2
        low, high = (t, high) if 0.5 * erfc(t / sqrt(2)) > share else (low, t)
    x = np.linspace(low, low + 8, 4001)
    tail = np.array([0.5 * erfc((low - cosine * v) / sqrt(2 * (1 - cosine**2))) for v in x])
    joint = float(np.sum(tail * np.exp(-x * x / 2)) * (x[1] - x[0]) / sqrt(2 * pi))
    return low, max(4, int(np.ceil(sqrt(common / joint))))


@lru_cache(maxsize=8)
def codes(dim: int, words: int) -> list[np.ndarray]:
    """Two blocks of code words (unit vectors where a block is wide), from fixed seeds."""
    out = []
    for block, width in enumerate((dim - dim // 2, dim // 2)):
        rng = np.random.default_rng([19, dim, words, block])
        rows = rng.standard_normal((words, width)) if width else np.zeros((words, 0))
        # in a narrow block unit words would hardly differ; there the normal length stays
        out.append(rows / (np.linalg.norm(rows, axis=1, keepdims=True) if width >= 8 else sqrt(max(width, 1))))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def decode(vectors: np.ndarray, words: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` of all filters (first code word * words + second) that unit vectors exceed the cap of.

    The blocks' norms differ between vectors, so a few would get none; each has at least a quarter
    of the expected number, its own best ones.
    """
    dim, parts = vectors.shape[1], []
    least = min(words * words, max(8, int(words * words * 0.25 * erfc(cap / sqrt(2)))))
    first, second = codes(dim, words)
    half, bar = dim - dim // 2, cap / sqrt(dim)
    # the best `least` sums take the i-th best first and the j-th best second word only where i * j <= least
    stairs = np.array([(i, j) for i in range(min(words, least)) for j in range(min(words, least // (i + 1)))])
    for at in range(0, len(vectors), step := max(1, 2_000_000 // words)):
        some = vectors[at : at + step]
        # a direction is (c1, c2) / sqrt 2, and an inner product of a random unit vector has variance 1 / dim
        left, right = some[:, :half] @ first.T / sqrt(2), some[:, half:] @ second.T / sqrt(2)
        order = np.argsort(-right, axis=1)
        falling = -np.take_along_axis(right, order, axis=1)
        row, i = np.nonzero(left >= bar + falling[:, :1])  # only these first words can reach the cap
        apart = 2 * max(np.abs(falling).max(initial=0), np.abs(left).max(initial=0)) + bar + 1
        lines = (falling + 2 * apart * np.arange(len(some))[:, None]).ravel()
        many = np.searchsorted(lines, left[row, i] - bar + 2 * apart * row, side="right") - row * words
        each = np.repeat(np.arange(len(row)), many)
        rank = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        owner, found = row[each], i[each] * words + order[row[each], rank]
        few = np.bincount(owner, minlength=len(some)) < least
        stays = ~few[owner]
        parts.append((at + owner[stays], found[stays]))
        for k in np.flatnonzero(few):  # an unlucky vector lowers its own cap until it has its share of filters
            best = np.argsort(-left[k])[: min(words, least)]
            one, two = best[stairs[:, 0]], order[k, stairs[:, 1]]
            top = np.argpartition(-(left[k, one] + right[k, two]), least - 1)[:least]
            parts.append((np.full(least, at + k), one[top] * words + two[top]))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts))


@lru_cache(maxsize=8)
def _signs(dim: int) -> np.ndarray:
    return np.random.default_rng([23, dim]).standard_normal((dim, 128))


def _near(batches):
    """Rows ``(filter, id, s0, s1)`` sorted by filter to those with a neighbour in their filter."""
    held = None
    for batch in _ended(batches):
        part = None if batch is None else [c.to_numpy() for c in batch.columns]
        rows = part if held is None else held if part is None else [np.concatenate(c) for c in zip(held, part)]
        if rows is None:
            continue
        size = len(rows[0])
        ends = size if part is None else int(np.searchsorted(rows[0], rows[0][-1])) if size else 0  # the last filter may go on
        held = [c[ends:] for c in rows]
        filter_, ids, s0, s1 = (c[:ends] for c in rows)
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        near = np.zeros(ends, dtype=bool)
        at, shift = np.arange(ends), 0
        while len(at):
            shift += 1
            at = at[at + shift < ends]
            at = at[filter_[at + shift] == filter_[at]]
            apart = np.bitwise_count(s0[at] ^ s0[at + shift]) + np.bitwise_count(s1[at] ^ s1[at + shift])
            hit = at[apart <= FAR]
            near[hit] = near[hit + shift] = True
        yield pa.RecordBatch.from_arrays([pa.array(filter_[near]), pa.array(ids[near])], names=["filter", "id"])


def _ended(batches):
    yield from batches
    yield None


def _verify(cosine: float):
    """Groups ``(filter, i, j)`` of rows with vectors to sums (``kind`` 0) and forest edges (1)."""

    def run(batches):
        out: list[tuple[np.ndarray, ...]] = []
        for (filter_, i, j), rows in runs(batches, ["filter", "i", "j"]):
            n = rows.num_rows
            if n < 2:
                continue
            ids, many, block = rows["id"].to_numpy(), rows["many"].to_numpy(), rows["block"].to_numpy()
            vectors = unit(rows["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, -1))
            linked = vectors @ vectors.T >= cosine
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block[None, :]
            if not linked.any():
                continue
            keep = linked.any(axis=1)
            linked, ids, many = linked[np.ix_(keep, keep)], ids[keep], many[keep]
            lists = rows["filters"].combine_chunks().filter(pa.array(keep))
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            smaller = flat < filter_
            flat, owner = flat[smaller], owner[smaller]
            _, column, shared = np.unique(flat, return_inverse=True, return_counts=True)
            owner, column = owner[shared[column] > 1], column[shared[column] > 1]  # a filter that one row has counts no pair
            counted = linked.copy()
            for low in range(0, len(shared), WIDE):
                now = (column >= low) & (column < low + WIDE)
                if now.any():
                    has = np.zeros((len(ids), WIDE), dtype=np.float32)
                    has[owner[now], column[now] - low] = 1
                    counted &= has @ has.T == 0
            sums = counted @ many
            label = np.arange(len(ids))
            while True:
                low = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
                low = low[low]
                if (low == label).all():
                    break
                label = low
            out.append((np.zeros(len(ids), dtype=np.int8), ids, sums.astype(np.int64)))
            out.append((np.ones(len(ids), dtype=np.int8), ids, ids[label]))
            if len(out) > 200:
                yield _packed(out)
                out = []
        if out:
            yield _packed(out)

    return run


def _packed(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["kind", "a", "b"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, common: float = COMMON, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    all_ = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    names = [F.xxhash64(e).alias("h0"), F.xxhash64(F.lit(1), e).alias("h1")]  # 128 bits name a vector
    classes = stored(all_.where(sound).select("id", "embedding", *names).groupBy("h0", "h1").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("embedding").alias("embedding")).withColumn("node", F.monotonically_increasing_id()))
    rows = classes.count()
    cap, words = parameters(rows, cosine, bucket, common)

    def filters(batches):
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                vectors_ = unit(lists.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), dim))
                bits = np.packbits(vectors_ @ _signs(int(dim)) > 0, axis=1).view(np.int64)
                nodes = batch.column(1).to_numpy()[at]
                owner, found = decode(vectors_, words, cap)
                found = found + int(dim) * words * words  # other dimensions are other filters
                for low in range(0, len(owner), 100_000):
                    some = owner[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(found[low : low + 100_000]), pa.array(nodes[some]), pa.array(bits[some, 0]), pa.array(bits[some, 1])], names=["filter", "id", "s0", "s1"])

    width = partitions(spark, rows, 4000)
    met = classes.select("embedding", "node").mapInArrow(filters, "filter long, id long, s0 long, s1 long")
    big = stored(met.groupBy("filter").count().where(F.col("count") > block).select("filter"))
    many_big = big.count()
    release(spark)
    if many_big:
        names_ = F.broadcast(big) if many_big <= BROADCAST else big
        crowded = met.join(names_, "filter", "left_semi").select("filter", "id")
        small = met.join(names_, "filter", "left_anti")
    else:
        crowded, small = None, met
    stays = small.repartition(width, "filter").sortWithinPartitions("filter").mapInArrow(_near, "filter long, id long")
    stays = stored(stays if crowded is None else stays.unionByName(crowded))
    release(spark)
    sizes = stays.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    own = stays.groupBy("id").agg(F.collect_list("filter").alias("filters"))  # a vector's filters: some tens
    own = classes.select(F.col("node").alias("id"), "many", "embedding").join(own, "id")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = stays.join(sizes, "filter").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    met = met.withColumn("tile", F.explode(tiles)).select("filter", "tile.i", "tile.j", "block", "id").join(own, "id")
    # many narrow partitions: the rows of a partition are sorted, and a group is two blocks at most
    grouped = met.repartition(width, "filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found = stored(grouped.mapInArrow(_verify(cosine), "kind byte, a long, b long").groupBy("kind", "a", F.when(F.col("kind") == 1, F.col("b")).alias("to")).agg(F.sum("b").alias("b")))
    release(spark)
    sums = found.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("others"))
    labels = components(found.where("kind = 1").select("a", F.col("to").alias("b"))).withColumnRenamed("id", "node")
    known = classes.select("h0", "h1", "id", "node", "many").join(sums, "node", "left").join(labels, "node", "left")
    known = stored(known.select("h0", "h1", "id", F.coalesce("component_id", "node").alias("of"), (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    least = known.groupBy("of").agg(F.min("id").alias("component_id"))
    known = known.join(least, "of").select("h0", "h1", "n_links", "component_id")
    out = all_.where(sound).select("id", *names).join(known, ["h0", "h1"]).select("id", "n_links", "component_id")
    alone = all_.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = stored(out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
    discard(classes, big, stays, found, known)
    return out


def op2_cap_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")
