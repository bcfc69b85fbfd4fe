"""Near copies: SimHash fingerprints within two bits, and 5-word shingle sets of similarity 0.8.

SimHash (``simhash.roots``) finds copies that differ in a few words; at a Jaccard similarity of 0.8
two 64-bit fingerprints differ in about ten bits, which no partition of the bits can be probed for.
So texts also meet in the buckets of ``BANDS`` keys, each a hash of ``ROWS`` minima of the shingle
set under random orders (a pair of similarity 0.8 shares a key with probability 0.9999), and whole
sets are compared there, however long.

Texts with the same words are one node throughout, and nodes start with the label of their
fingerprint's component.  A bucket whose nodes have one label asks for nothing.  Others are groups
of at most ``block`` nodes and ``heavy`` shingles: a larger bucket is dealt to several, each of
which holds the bucket's first node too, so a large set of copies comes together through it.  A
group compares nodes of different labels only: sketches of one byte a minimum pass over pairs below
``SLACK`` (5 standard errors under the limit), whole sets decide the others, and a group returns
which labels it joined, never its pairs.  The first ``FIRST`` bands run alone, and what they join
leaves most other buckets with one label.  Buckets of several groups that still hold several labels
are then split by ``FURTHER`` keys of three more minima; a part that is still too large is dealt to
blocks and every two blocks are compared, so no pair that shares a key is left out for its size.

Null and empty texts have no shingles and link by their fingerprint only, all with one another.
Null ids, shared ids and repeated rows are rows like any other: nothing here is keyed by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, discard, distinct, packed40, partitions, release, runs, stored, unpacked40
from .decontaminate import grams

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
FIRST = 8  #: bands whose buckets are compared before the others
FURTHER = 8  #: keys that split a bucket of several groups
SLACK = 0.65  #: least share of equal sketch bytes of a pair whose sets are compared
BLOCK = 2000  #: most nodes of a group
HEAVY = 2_000_000  #: most shingles of a group of several nodes, on average
_LOW40 = np.uint64((1 << 40) - 1)  #: sets travel as 40-bit hashes
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A hash for every shingle, repeats included; fewer words than ``width`` are one shingle."""
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    return grams(own, min(width, len(own))) if len(own) else own


def sketch(own: np.ndarray) -> tuple[bytes, np.ndarray]:
    """One byte for each minimum, and the band keys, of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 512):
        mixed = (own[None, at : at + 512] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows, out = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for r in range(ROWS):
        out = (out ^ rows[:, r]) * _ODD
        out ^= out >> np.uint64(29)
    return ((least * _ODD) >> np.uint64(56)).astype(np.uint8).tobytes(), out.view(np.int64)


def _keyed(batches):
    for batch in batches:
        ids, marks, same, fps, sizes, bytes_, bands = [], [], [], [], [], [], []
        for i, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = _words(text)
            every = shingles(words)
            own = distinct(every)
            low, keys = sketch(own) if len(own) else (b"", [])
            ids.append(i)
            marks.append(mark)
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            fps.append(simhash.folded(every))
            sizes.append(len(own))
            bytes_.append(low)
            bands.append(keys)
        columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(same, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "same", "fp", "size", "low", "bands"])


def _sets(batches):
    for batch in batches:
        own = [packed40(distinct(shingles(_words(t)) & _LOW40)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["same", "own"])


def joined(label: np.ndarray, low: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """The pairs of labels that links between these nodes join, as a forest."""
    label, out = label.copy(), []
    least = np.floor(SLACK / SIMILARITY * similarity * low.shape[1])
    for i in range(len(sets) - 1):
        apart = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(apart):
            apart = apart[(low[apart] == low[i]).sum(axis=1) >= least]
        for at in range(0, len(apart), 256):  # bounds the sets held together
            some = [j for j in apart[at : at + 256].tolist() if label[j] != label[i]]
            if not some:
                continue
            flat = np.concatenate([sets[j] for j in some])
            sizes = np.array([len(sets[j]) for j in some])
            place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for j, n in zip(np.array(some)[both >= similarity * (sizes + len(sets[i]) - both)], both):
                if label[j] != label[i]:
                    out.append((int(label[i]), int(label[j])))
                    label[label == label[j]] = label[i]
    return out


def _grouped(similarity: float):
    """Rows sorted by ``key, part`` to the labels that each group joins."""

    def run(batches):
        for _, rows in runs(batches, ["key", "part"]):
            label = rows["label"].to_numpy()
            if (label == label[0]).all():
                continue
            low = np.frombuffer(b"".join(rows["low"].to_pylist()), dtype=np.uint8).reshape(len(label), -1)
            edges = joined(label, low, [unpacked40(s) for s in rows["own"].to_pylist()], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def marked(docs: DataFrame, text_col: str = "text") -> Column:
    """A 128-bit name of each text."""
    return F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: ``id, mark`` (the text's name) and ``component``, equal for rows that links connect."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), marked(docs, text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    keyed = stored(texts.mapInArrow(_keyed, "id long, mark binary, same binary, fp long, size long, low binary, bands array<long>"))
    roots = stored(simhash.roots(keyed.select("fp").distinct()))
    nodes = stored(keyed.where("size > 0").dropDuplicates(["same"]).join(roots, "fp").select("same", "id", "mark", "size", "low", "bands", "root"))
    entries = nodes.select("same", F.posexplode("bands").alias("band", "key"), "root")
    shared = entries.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "key")
    members = stored(entries.join(shared, ["band", "key"]).select("same", "band", "key"))
    involved = stored(nodes.join(members.select("same").distinct(), "same", "left_semi").drop("bands"))
    found = texts.alias("t").join(involved.select("same", F.col("id").alias("of"), F.col("mark").alias("named")), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("named")))
    sets = stored(found.select("same", "text").dropDuplicates(["same"]).mapInArrow(_sets, "same binary, own binary"))
    release(spark)
    names = involved.select("same", "root", F.col("root").alias("label"))  # label: the component so far

    def linked(cells: DataFrame) -> DataFrame:
        """Labels joined by the groups ``cells(key, part, same, label)``."""
        rows = cells.join(sets, "same").join(involved.select("same", "low"), "same")
        width = partitions(spark, cells.count(), 4000)
        return stored(rows.select("key", "part", "label", "low", "own").repartition(width, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_grouped(similarity), "a long, b long").distinct())

    def merged(names: DataFrame, cells: DataFrame) -> DataFrame:
        to = components(linked(cells)).select(F.col("id").alias("label"), F.col("component_id").alias("to"))
        out = stored(names.join(to, "label", "left").select("same", "root", F.coalesce("to", "label").alias("label")))
        release(spark)
        return out

    def alive(entries: DataFrame, keys: list[str]) -> DataFrame:
        """Entries of buckets with several labels, with how many groups the bucket takes and its first node."""
        bucket = entries.groupBy(*keys).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), F.sum("size").alias("size"), F.min(F.struct("same", "label")).alias("head"))
        width = F.greatest(F.ceil(F.col("n") / block), F.least(F.ceil(F.col("size") / heavy), F.col("n"))).cast("int")
        return bucket.where("a <> b").select(*keys, width.alias("groups"), "head")

    sizes = involved.select("same", "size")
    for low, high in ((0, FIRST), (FIRST, BANDS)):
        now = members.where(F.col("band").between(low, high - 1)).join(names, "same").join(sizes, "same")
        buckets = alive(now, ["band", "key"])
        own = F.xxhash64("band", "key")
        cells = now.join(buckets, ["band", "key"]).select(own.alias("key"), F.pmod(F.xxhash64("same"), F.col("groups")).cast("int").alias("part"), "same", "label")
        heads = buckets.where("groups > 1").select(own.alias("key"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "head.same", "head.label")
        names = merged(names, stored(cells.unionByName(heads)))
    # buckets of several groups: nodes of different groups have met through the first node only
    now = members.join(names, "same").join(sizes, "same")
    large = stored(now.join(alive(now, ["band", "key"]).where("groups > 1").select("band", "key"), ["band", "key"]))
    if not large.isEmpty():
        part = F.explode(F.array(*[F.concat(F.lit(bytes([k])), F.substring(F.col("low"), 3 * k * (BANDS * ROWS // 3 // FURTHER) + 1, 3)) for k in range(FURTHER)])).alias("more")
        finer = large.join(involved.select("same", "low"), "same").select("band", "key", part, "same", "label", "size")
        cells = finer.join(alive(finer, ["band", "key", "more"]), ["band", "key", "more"])
        mine = F.pmod(F.xxhash64("same"), F.col("groups")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda other: F.least(other, mine) * F.col("groups") + F.greatest(other, mine))
        names = merged(names, stored(cells.select(F.xxhash64("band", "key", "more").alias("key"), F.explode(tiles).alias("part"), "same", "label")))
    of = names.groupBy("root").agg(F.min("label").alias("label"))
    rows = keyed.select("id", "mark", "fp").join(roots, "fp").join(of, "root", "left")
    out = stored(rows.select("id", "mark", F.coalesce("label", "root").alias("component")))
    release(spark)
    discard(keyed, roots, nodes, members, involved, sets, large)
    return out


def firsts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (null ids last).

    Rows that share this id and differ in text count by their text's name; of rows equal in both one stays.
    """
    rows = found.groupBy("component", "id", "mark").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "rows")).alias("first")
    kept = stored(rows.groupBy("component").agg(first).select(F.col("first.id").alias("_id"), F.col("first.mark").alias("_mark"), F.col("first.rows").alias("_rows")))
    here = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (marked(docs, text_col) == F.col("_mark"))
    once = docs.join(kept.where("_rows = 1"), here, "left_semi")
    again = kept.where("_rows > 1")
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, here, "left_semi").dropDuplicates([id_col, text_col]))
