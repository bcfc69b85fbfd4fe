"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An item of L words that a passage copies with at most ``e = floor((1 - SIMILARITY) * L)`` edited
words keeps at least ``T = L - n + 1 - n * e`` of its n-grams.  By the pigeonhole principle it then
keeps at least one of any ``L - n + 1 - T + 1`` of them, so the rarest that many are its seeds: rarity
is the n-gram's document frequency, counted over all documents.  n is 3, or less where an item is
too short for T to be positive.  Every seed hit gives a passage; item and passage are aligned by
Smith-Waterman over words, and the score is the share of item words that the alignment matches.

The test items are a stated query set: they are held in blocks of at most ``BLOCK_BYTES`` of text,
each broadcast by itself, and every block meets all documents.  Documents are read twice (counts,
then search and alignment) and never shuffled; only counts of item n-grams and the pairs found are.

Words: lower case, letters and digits of any script; markup and punctuation only separate.  Null or
empty texts and items have no words and match nothing.  Equal items are reported each; repeated
documents are reported each.  No item or no document gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, table

SIMILARITY = 0.8
GRAM = 3
BLOCK_BYTES = 8_000_000
FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), dtype=np.uint64, count=len(tokens))


def grams(own: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n words at every position (``own``: one a word)."""
    if len(own) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(own) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ own[k : len(own) - n + 1 + k]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def needed(length: int, n: int, similarity: float) -> int:
    """How many n-grams of an item of ``length`` words a copy keeps at least."""
    return length - n + 1 - n * int((1 - similarity) * length + 1e-9)


def gram_size(length: int, similarity: float, most: int = GRAM) -> int:
    return next((n for n in range(min(most, length), 0, -1) if needed(length, n, similarity) > 0), 0)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (match 4, mismatch -1, gap -1): matched words, first and last passage word."""
    n, m = len(item), len(passage)
    score = np.zeros((n + 1, m + 1), dtype=np.int32)
    hit = item[:, None] == passage[None, :]
    gap = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, dtype=np.int32)
        row[1:] = np.maximum(score[i - 1, :-1] + np.where(hit[i - 1], 4, -1), score[i - 1, 1:] - 1)
        np.maximum(row, 0, out=row)
        # gaps in the item: a running maximum over score + position
        score[i] = np.maximum.accumulate(row + gap) - gap
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    last, matched = int(j) - 1, 0
    while i > 0 and j > 0 and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + (4 if hit[i - 1, j - 1] else -1):
            matched += bool(hit[i - 1, j - 1])
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return matched, int(j), last


class Items:
    """A block of items with their n-grams, and after ``choose`` their seeds."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids = [i for i, _ in rows]
        self.own = [_hashes(words(t)) for _, t in rows]
        self.size = [gram_size(len(o), similarity) for o in self.own]
        pairs = [(int(h), k, at) for k, (o, n) in enumerate(zip(self.own, self.size)) if n for at, h in enumerate(grams(o, n))]
        self.sizes = sorted({n for n in self.size if n})
        self.all = np.unique(np.array([h for h, _, _ in pairs], dtype=np.uint64))
        self.pairs = pairs
        self.seeds = np.zeros(0, dtype=np.uint64)
        self.postings: dict[int, list[tuple[int, int]]] = {}

    def choose(self, frequency: dict[int, int]) -> None:
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for h, k, at in self.pairs:
            by_item.setdefault(k, []).append((frequency.get(h, 0), h, at))
        self.postings = {}
        for k, found in by_item.items():
            keep = needed(len(self.own[k]), self.size[k], self.similarity)
            for _, h, at in sorted(found)[: len(found) - keep + 1]:
                self.postings.setdefault(h, []).append((k, at))
        self.seeds = np.array(sorted(self.postings), dtype=np.uint64)
        self.pairs = []

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """``(item_id, score, first word, last word)`` of the best passage for each item found."""
        own = _hashes(words(text))
        hits: dict[int, list[int]] = {}
        for n in self.sizes:
            g = grams(own, n)
            for at in np.nonzero(_among(g, self.seeds))[0].tolist():
                for k, where in self.postings[int(g[at])]:
                    if self.size[k] == n:
                        hits.setdefault(k, []).append(at - where)
        out = []
        for k, starts in hits.items():
            item = self.own[k]
            length, best = len(item), None
            slack = int((1 - self.similarity) * length + 1e-9) + 1
            done = -1
            for start in sorted(set(starts)):
                if start <= done:  # inside the passage just aligned
                    continue
                low, high = max(0, start - slack), min(len(own), start + length + 2 * slack)
                done = start + slack
                passage = own[low:high]
                if _overlap(item, passage) < self.similarity * length - 1e-9:
                    continue
                matched, first, last = align(item, passage)
                if best is None or matched > best[0]:
                    best = (matched, low + first, low + last)
            if best and best[0] >= self.similarity * length - 1e-9:
                out.append((self.ids[k], best[0] / length, best[1], best[2]))
        return out


def _overlap(item: np.ndarray, passage: np.ndarray) -> int:
    """Item words that occur in the passage at all: no alignment matches more."""
    return int(np.isin(item, passage).sum())


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(values) or not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _frequencies(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each item n-gram occurs."""
    held = docs.sparkSession.sparkContext.broadcast((items.all, items.sizes))

    def run(batches):
        known, sizes = held.value
        count = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = _hashes(words(text))
                for n in sizes:
                    g = grams(own, n)
                    count[np.searchsorted(known, distinct(g[_among(g, known)]))] += 1
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(count[at])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram & 0xFFFFFFFFFFFFFFFF: r.n for r in rows}  # at most the n-grams of one block of items


def _blocks(items: DataFrame, limit: int):
    """Items in blocks of at most ``limit`` bytes of text (one item at least), by id."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).orderBy("item_id").toLocalIterator():
        many = len(r.text.encode())
        if rows and size + many > limit:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += many
    if rows:
        yield rows


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item of which it holds a copy: ``doc_id, item_id, score, first_word, last_word``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for rows in _blocks(items, block_bytes):
        block = Items(rows, similarity)
        block.choose(_frequencies(docs.select("text"), block))
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            own = held.value
            for batch in batches:
                out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in own.search(text)]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        part = docs.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], FOUND)


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold a copy of no item."""
    at, source = docs.columns.index("text"), docs
    for rows in _blocks(items, block_bytes):
        block = Items(rows, similarity)
        block.choose(_frequencies(source.select("text"), block))
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            own = held.value
            for batch in batches:
                yield batch.filter(pa.array([not own.search(text) for text in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_seed_align_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
