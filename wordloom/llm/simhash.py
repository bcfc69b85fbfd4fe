"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: words (A-Z lowered, split on ASCII white space) form 3-word shingles, repeats
included; a bit is set when more than half of the shingles' XXH64 (seed 42) have it.

Search: the 64 bits are cut into m partitions and each gets its own threshold, with
``sum(thresholds) = radius - m + 1`` (-1: the partition is not probed).  Two fingerprints within
the radius then agree, in at least one probed partition, up to its threshold.  Correlated bits
(measured on a bounded sample) share a partition, so what the partitions say is as independent as
the data allow, and dynamic programming gives every partition the threshold that costs the fewest
probes and estimated candidates.  Fingerprints meet on partition values and are verified exactly.

Large buckets never become pairs: members of a bucket above ``bucket_limit`` are joined on all
65 values within one bit of each.  Two fingerprints that share such a value differ in at most two
bits, and two that differ in at most two bits share one, so this way is exact for radius 2 and
its groups hold at most 65 different fingerprints; their smallest one stands for the group.

Equal fingerprints are one node throughout (its smallest id), whatever the number of copies.
Null and empty texts, and texts of white space, have fingerprint zero and are linked like others.
Rows repeated in full keep one row each.  Rows with a null id are linked by their texts like others;
the smallest id of a component is taken over the ids that are not null, and is null if all are.
Only the id and the text are read; other columns, whatever their names, are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, partitions, release, table

RADIUS = 2
SAMPLE = 20_000  #: fingerprints that the plan is estimated on
BUCKET_LIMIT = 64
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        join, digest = b" ".join, xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(join(s), 42) for s in zip(*(words[k:] for k in range(width)))), dtype=np.uint64, count=len(words) - width + 1)
    return folded(hashes)


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, repeats included: the bits that over half of them have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long, one row per input row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def plan(sample: np.ndarray, rows: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions (bit positions) and thresholds that cost least for ``rows`` fingerprints.

    Cost of a partition at threshold t: its probes plus the candidates they meet, the latter from
    the share of sample pairs within t on those bits (random pairs of the sample that are not near copies,
    and never less than uniform bits would give).  Tried: 1 to radius + 2 partitions, thresholds by dynamic
    programming over the partitions.
    """
    bits = ((sample[:, None] >> _BITS[None, :]) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0) if len(bits) else np.zeros(64)
    together = np.abs(np.corrcoef(bits[:, spread > 0].T)) if (spread > 0).sum() > 1 else np.eye(int((spread > 0).sum()))
    near = np.zeros((64, 64))
    near[np.ix_(spread > 0, spread > 0)] = np.nan_to_num(together)
    half = len(sample) // 2
    apart = sample[:half] ^ sample[half : 2 * half]
    apart = apart[np.bitwise_count(apart) > 4 * radius]  # nearer pairs are mostly links, whose large buckets stay linear
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, radius + 3):
        groups = _grouped(near, m)
        cost = np.full((m, radius + 2), np.inf)
        for p, group in enumerate(groups):
            mask = np.uint64(sum(1 << b for b in group))
            distance = np.bitwise_count(apart & mask) if len(apart) else np.zeros(0, dtype=np.uint8)
            cost[p, 0] = 0.0  # threshold -1
            probes, uniform = 0.0, 0.0
            for t in range(radius + 1):
                probes += _choose(len(group), t)
                uniform += _choose(len(group), t) / 2.0 ** len(group)
                seen = (distance <= t).mean() if len(distance) else 0.0
                cost[p, t + 1] = probes + rows * max(uniform, seen) / 2
        total = radius - m + 1
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for p in range(m):
            step: dict[int, tuple[float, list[int]]] = {}
            for have, (so_far, chosen) in reach.items():
                for t in range(-1, radius + 1):
                    c = so_far + cost[p, t + 1]
                    if have + t not in step or c < step[have + t][0]:
                        step[have + t] = (c, [*chosen, t])
            reach = step
        if total in reach and (best is None or reach[total][0] < best[0]):
            best = (reach[total][0], [(g, t) for g, t in zip(groups, reach[total][1]) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> float:
    return float(np.prod([(n - i) / (i + 1) for i in range(k)])) if k else 1.0


def _grouped(near: np.ndarray, m: int) -> list[list[int]]:
    """Bits into m groups of near-equal size: each next bit joins the open group it correlates with most."""
    left, groups = list(range(64)), [[] for _ in range(m)]
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    for group, size in zip(groups, sizes):
        group.append(left.pop(0))
        while len(group) < size:
            pick = max(range(len(left)), key=lambda i: near[left[i], group].sum())
            group.append(left.pop(pick))
    return [sorted(g) for g in groups]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _flips(bits: list[int], most: int) -> list[int]:
    """XOR masks of every change of at most ``most`` of these bits."""
    singles = [_mask([b]) for b in bits]
    out = [0]
    if most >= 1:
        out += singles
    if most >= 2:
        out += [a ^ b for i, a in enumerate(singles) for b in singles[:i]]
    return out


def links(nodes: DataFrame, chosen: list[tuple[list[int], int]], bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` between different fingerprints of ``nodes(fp)`` that connect all within radius 2."""
    parts = []
    for number, (bits, most) in enumerate(chosen):
        base = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        keys = F.array(base) if most == 0 else F.transform(F.array(*[F.lit(x) for x in _flips(bits, most)]), lambda x: x.bitwiseXOR(base))
        parts.append(nodes.select(F.lit(number).alias("part"), F.explode(keys).alias("key"), "fp"))
    member = parts[0]
    for part in parts[1:]:
        member = member.unionByName(part)
    sizes = member.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = member.join(sizes, ["part", "key"])
    small = member.where(F.col("n") <= bucket_limit).groupBy("part", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    a_b = small.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    pairs = a_b.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    near = F.transform(F.array(*[F.lit(x) for x in _flips(list(range(64)), 1)]), lambda x: x.bitwiseXOR(F.col("fp")))
    around = member.where(F.col("n") > bucket_limit).select("fp").distinct().select("fp", F.explode(near).alias("near"))
    heads = around.groupBy("near").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(heads, "near").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def roots(nodes: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(fp, root)`` for different fingerprints ``nodes(fp)``: the same root for all that links connect."""
    nodes = cut(nodes)
    count = nodes.count()
    share = min(1.0, 2.0 * SAMPLE / max(1, count))
    picked = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(SAMPLE)
    sample = np.array([r.fp for r in picked.collect()], dtype=np.int64).view(np.uint64)
    sample = np.random.default_rng(7).permutation(np.sort(sample))
    by_fp = components(links(nodes, plan(sample, count), bucket_limit))
    return nodes.join(by_fp, nodes.fp == by_fp.id, "left").select("fp", F.coalesce("component_id", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: ``id, fp (signed long), component_id``; fingerprints link at ``RADIUS`` bits."""
    spark = docs.sparkSession
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    linked = nodes.join(roots(nodes.select("fp"), bucket_limit), "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = linked.join(least, "root").select("fp", "component_id")
    release(spark)
    return prints.join(labels, "fp").select("id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), "component_id")
