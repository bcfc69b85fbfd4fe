"""Language-model scoring by context-tree weighting.

Model: every byte is eight binary decisions (a heap of 255 prefixes).  Each decision has a
Krichevsky-Trofimov estimate under the contexts of 0 to ``DEPTH`` preceding bytes, and the weighting
recursion ``P_w(s) = KT(s) / 2 + prod P_w(children) / 2`` gives, in one pass over the counts, how
much of the mixture each depth gets at every decision.  A context that no training text holds takes
no part in the mixture.  Counts come from all training documents, and every context they hold has
its node, so the model grows with the corpus.  The score is the sum of log10 probabilities of a
text's bytes and of its end.

No task holds the model.  Contexts are dealt to buckets by their newest three bytes, so the tree
below depth 2 falls apart into whole subtrees; only the tree down to depth 2 (at most 2**16 + 257
contexts) is gathered and broadcast.  A byte's probability depends on it and the five bytes before:
a batch of documents asks each bucket once for its different six-byte keys, and gets a number each.

Base: add-one unigrams over tokens (words with A-Z lowered and one end token a document), counted
over all training documents.  Tokens are named by a 64-bit hash.  The most frequent ones (at most
``FREQUENT``) are broadcast, so that they need no shuffle and cannot skew it; all others are joined.

Null texts are empty.  Rows that repeat in full, share an id or have none give a row each.  Contexts
are bytes of the text as it is (only the base lowers A-Z).  Other columns are not read.  With no training documents every
decision has probability one half and the base score is that of empty counts.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, fold, partitions, release, stored, table

DEPTH = 5
TOP = 2  #: depth down to which the tree is broadcast; all below is dealt to buckets
PER_BUCKET = 1 << 14  #: about so many six-byte keys a bucket
FREQUENT = 1 << 16  #: most tokens whose counts are broadcast; the rest is joined
FLUSH_BYTES = 3_000_000
_END = xxhash.xxh64_intdigest(b" ")  # no word holds a space
_LG_HALF = 0.5723649429247001  # ln Gamma(1/2)


_SMALL = 1 << 16
_HALVES = np.concatenate([[_LG_HALF], _LG_HALF + np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))])  # ln Gamma(n + 1/2)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])  # ln Gamma(n + 1)


def _lgamma(n: np.ndarray, table_: np.ndarray, more: float) -> np.ndarray:
    """ln Gamma(n + more) for counts: a table, and Stirling's series beyond it."""
    out = table_[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    if large.any():
        y = n[large] + more
        out[large] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y)
    return out


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte counts (..., 256) to zeros and ones of the 255 decisions, heap order from index 0."""
    level, left, right = counts, [], []
    while level.shape[-1] > 1:
        pair = level.reshape(*level.shape[:-1], level.shape[-1] // 2, 2)
        left.append(pair[..., 0])
        right.append(pair[..., 1])
        level = pair.sum(axis=-1)
    return np.concatenate(left[::-1], axis=-1), np.concatenate(right[::-1], axis=-1)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros, _HALVES, 0.5) + _lgamma(ones, _HALVES, 0.5) - _lgamma(zeros + ones, _WHOLES, 1.0) - 2 * _LG_HALF


_PATH = np.array([[(1 << k) - 1 + (byte >> (8 - k)) for k in range(8)] for byte in range(256)])
_BIT = np.array([[byte >> (7 - k) & 1 for k in range(8)] for byte in range(256)], dtype=bool)


def _log10(one: np.ndarray) -> np.ndarray:
    """Probabilities that a decision is 1, (..., 255), to log10 of every byte, (..., 256)."""
    at = one[..., _PATH]
    return np.log10(np.where(_BIT, at, 1 - at)).sum(axis=-1)


class Model:
    """Predictive tables of a context tree that fits in memory, the dense form of ``Tree``.

    ``levels``: for depth 0 to D, ``(keys, counts)`` of ``context << 8 | byte`` for the contexts that
    have a node; a context's lowest byte is the newest, so a child's key extends its parent's above.
    ``child[row, byte]`` is the row of the context one older byte longer, or -1.
    """

    CHUNK = 512

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        contexts = [np.unique(keys >> 8) for keys, _ in levels]
        if not len(contexts[0]):
            contexts[0] = np.zeros(1, dtype=np.int64)
        depth = len(levels) - 1
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        nodes = [self._bytes(c, *level) for c, level in zip(contexts, levels)]
        parent = [None] + [np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)]
        self.child = np.full((first[depth], 256), -1, dtype=np.int32)
        for d in range(1, depth + 1):
            self.child[first[d - 1] + parent[d], contexts[d] >> 8 * (d - 1)] = first[d] + np.arange(len(contexts[d]))
        half = np.log(0.5)
        keep: list[np.ndarray | None] = [None] * (depth + 1)  # what a context keeps of its share, by decision
        weighted = None
        for d in range(depth, -1, -1):
            below = np.zeros((len(contexts[d]), 255), dtype=np.float64) if d < depth else None
            if d < depth:
                rest = nodes[d].astype(np.float64)
                np.subtract.at(rest, parent[d + 1], nodes[d + 1])
                np.add.at(below, parent[d + 1], weighted)
                below += _log_kt(*_decisions(rest))
            own = np.empty((len(contexts[d]), 255), dtype=np.float32)
            share = np.zeros((len(contexts[d]), 255), dtype=np.float32) if d < depth else None
            for at in range(0, len(own), self.CHUNK):
                cut = slice(at, at + self.CHUNK)
                kt = _log_kt(*_decisions(nodes[d][cut].astype(np.float64)))
                if d < depth:
                    w = np.logaddexp(half + kt, half + below[cut])
                    share[cut] = np.exp(half + kt - w)
                    own[cut] = w
                else:
                    own[cut] = kt
            weighted, keep[d] = own, share
        self.table = np.empty((first[-1], 256), dtype=np.float32)
        # from the root down: what shorter contexts have given, what is left, and the mixture so far
        given = np.zeros((1, 255), dtype=np.float32)
        left = np.ones((1, 255), dtype=np.float32)
        mixed = np.full((1, 255), 0.5, dtype=np.float32)
        for d in range(depth + 1):
            up = parent[d] if d else np.zeros(1, dtype=np.int64)
            shape = (len(contexts[d]), 255)
            new = [np.empty(shape, dtype=np.float32) for _ in range(3)] if d < depth else None
            for at in range(0, shape[0], self.CHUNK):
                cut = slice(at, at + self.CHUNK)
                zeros, ones = _decisions(nodes[d][cut].astype(np.float64))
                kt = (ones + 0.5) / (zeros + ones + 1)
                mix = np.where(zeros + ones > 0, given[up[cut]] + left[up[cut]] * kt, mixed[up[cut]])
                self.table[first[d] + at : first[d] + at + len(mix)] = _log10(mix)
                if d < depth:
                    new[0][cut] = given[up[cut]] + left[up[cut]] * keep[d][cut] * kt
                    new[1][cut] = left[up[cut]] * (1 - keep[d][cut])
                    new[2][cut] = mix
            if d < depth:
                given, left, mixed = new
        self.depth = depth

    @staticmethod
    def _bytes(contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(contexts), 256), dtype=np.float32 if counts.max(initial=0) < 1 << 24 else np.float64)
        if len(keys):
            out[np.searchsorted(contexts, keys >> 8), keys & 255] = counts
        return out

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < 1_000_000:
                size += len(texts[end])
                end += 1
            out[at:end] = self._block(texts[at:end])
            at = end
        return out

    def _block(self, texts: list[bytes]) -> np.ndarray:
        pad = self.depth
        data = np.frombuffer(b"".join(b"\0" * pad + t + b"\0" for t in texts), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + pad + 1 for t in texts])[:-1]])
        row = np.zeros(len(data) - pad, dtype=np.int32)
        alive = np.arange(len(row), dtype=np.int32)
        for d in range(1, pad + 1):
            to = self.child[row[alive], data[pad - d + alive]]
            alive, to = alive[to >= 0], to[to >= 0]
            row[alive] = to
        each = np.zeros(len(data))
        each[pad:] = self.table[row, data[pad:]]
        for k in range(pad):
            each[starts + k] = 0
        return np.add.reduceat(each, starts)


def _hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _grams(texts: list[bytes], depth: int) -> np.ndarray:
    """Keys ``context << 8 | byte`` of every byte and end; the newest context byte is the lowest."""
    data = np.frombuffer(b"".join(b"\0" * depth + t + b"\0" for t in texts), dtype=np.uint8)
    key = np.zeros(len(data) - depth, dtype=np.int64)
    for d in range(depth, 0, -1):
        key = (key << 8) | data[depth - d : len(data) - d]
    key = (key << 8) | data[depth:]
    inside = np.ones(len(data), dtype=bool)
    starts = np.concatenate([[0], np.cumsum([len(t) + depth + 1 for t in texts])[:-1]])
    for k in range(depth):
        inside[starts + k] = False
    return key[inside[depth:]]


def _counts(depth: int):
    """Training texts to ``(kind, key, n)``: kind 0 byte contexts with their byte, kind 1 tokens."""

    def rows(kind, keys, n):
        for at in range(0, len(keys), 1 << 17):
            k = keys[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, dtype=np.int8)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 17)].astype(np.int64))], names=["kind", "key", "n"])

    def flush(texts):
        yield from rows(0, *np.unique(_grams(texts, depth), return_counts=True))
        yield from rows(1, *np.unique(np.concatenate([*map(_hashes, texts), np.full(len(texts), _END, dtype=np.uint64)]), return_counts=True))

    def run(batches):
        texts, total = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append((text or "").encode())
                total += len(texts[-1])
                if total >= FLUSH_BYTES:
                    yield from flush(texts)
                    texts, total = [], 0
        if texts:
            yield from flush(texts)

    return run


def _split(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted ``context << 8 | byte`` to ``(context and first k bits, zeros, ones)`` for k from 0 to 7."""
    out = []
    for k in range(8):
        decisions = keys >> (8 - k)
        first = np.flatnonzero(np.concatenate([[True], decisions[1:] != decisions[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        ones = np.add.reduceat(np.where(keys >> (7 - k) & 1, counts, 0.0), first) if len(keys) else np.zeros(0)
        both = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
        out.append((decisions[first], both - ones, ones))
    return out


def _gathered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.float64), first)


class Tree:
    """The decisions of depths ``low`` to ``high`` that occur, each with its counts and what it keeps.

    ``keys, counts``: ``context << 8 | byte`` at depth ``high``.  ``below``: for each of the eight
    bits of a byte ``(decisions, log weights)`` of depth ``high``'s children, summed; None at ``DEPTH``.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int, below=None):
        half = np.log(0.5)
        self.depths, counts = [], counts.astype(np.float64)
        for d in range(high, low - 1, -1):
            keys, counts = _gathered(keys & ((1 << 8 * (d + 1)) - 1), counts)
            steps, up = [], []
            for k, (decisions, zeros, ones) in enumerate(_split(keys, counts)):
                own = _log_kt(zeros, ones)
                weighted, keep = own, np.ones(len(own))
                if below is not None:
                    at = np.searchsorted(decisions, below[k][0])
                    weighted = np.logaddexp(half + own, half + np.bincount(at, weights=below[k][1], minlength=len(own)))
                    keep = np.exp(half + own - weighted)
                steps.append((decisions, (ones + 0.5) / (zeros + ones + 1), keep))
                up.append((decisions & ((1 << 8 * max(d - 1, 0) + k) - 1), weighted))
            self.depths.append((d, steps))
            below = up
        self.depths.reverse()
        self.up = below  #: by bit, the decision one depth above ``low`` and the log weight that it gets

    def _at(self, keys: np.ndarray, k: int, given: np.ndarray, left: np.ndarray, mixed: np.ndarray):
        for d, steps in self.depths:
            decisions, one, keep = steps[k]
            if len(decisions):
                want = keys >> (8 - k) & ((1 << 8 * d + k) - 1)
                at = np.minimum(np.searchsorted(decisions, want), len(decisions) - 1)
                mixed = np.where(decisions[at] == want, given + left * one[at], mixed)
                given, left = given + left * keep[at] * one[at], left * (1 - keep[at])
        return given, left, mixed

    def log10(self, keys: np.ndarray, top: Tree) -> np.ndarray:
        """log10 probability of each key's byte after its context; ``top`` is the tree above this one."""
        out = np.zeros(len(keys))
        for k in range(8):
            state = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
            one = self._at(keys, k, *top._at(keys, k, *state))[2]
            out += np.log10(np.where(keys >> (7 - k) & 1, one, 1 - one))
        return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context's newest three bytes (``_bucket_of`` in Spark)."""
    return ((keys >> 8 & 0xFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 12 & (buckets - 1)


def _bucket_of(key: Column, buckets: int) -> Column:
    mixed = (F.shiftright(key, 8).bitwiseAND(F.lit(0xFFFFFF)) * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(mixed, 12).bitwiseAND(F.lit(buckets - 1))


def _packed(keys: np.ndarray) -> bytes:
    """Keys of six bytes by byte position: sorted keys are nearly constant in the first."""
    return zlib.compress(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, 5::-1] = planes.T
    return out.view("<i8").ravel()


def _runs(batch: pa.RecordBatch):
    """Slices of a sorted batch with one bucket and either counts or questions only."""
    bucket, asks = batch.column(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (asks[1:] != asks[:-1])) + 1
    for a, b in pairwise([0, *cuts.tolist(), len(bucket)]):
        if b > a:
            yield int(bucket[a]), bool(asks[a]), batch.slice(a, b - a)


def _subtree(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, Tree]:
    keys = np.concatenate([np.zeros(0, dtype=np.int64), *(p.column(1).to_numpy() for p in parts)])
    counts = np.concatenate([np.zeros(0), *(p.column(2).to_numpy() for p in parts)])
    order = np.argsort(keys)
    return keys[order], Tree(keys[order], counts[order], TOP + 1, DEPTH)


def _risen(batches):
    """Counts by bucket to what depth ``TOP`` needs of it: log weights by bit, and (bit 8) its counts."""

    def rows(parts):
        keys, tree = _subtree(parts)
        counts = np.concatenate([p.column(2).to_numpy() for p in parts])[np.argsort(np.concatenate([p.column(1).to_numpy() for p in parts]))]
        for k, (at, weight) in enumerate([*tree.up, (keys & ((1 << 8 * (TOP + 1)) - 1), counts)]):
            own, weight = _gathered(at, weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, dtype=np.int8)), pa.array(own), pa.array(weight)], names=["bit", "at", "weight"])

    now, parts = None, []
    for batch in batches:
        for bucket, _, part in _runs(batch):
            if bucket != now and parts:
                yield from rows(parts)
                parts = []
            now = bucket
            parts.append(part)
    if parts:
        yield from rows(parts)


def _asked(buckets: int):
    """Documents to batches: the different keys of a batch by bucket, and its texts."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        names = ["batch", "bucket", "blob", "ids", "sizes"]

        def made(ids, texts):
            keys = distinct(_grams(texts, DEPTH))
            of = _bucket(keys, buckets)
            order = np.argsort(of, kind="stable")
            keys, of = keys[order], of[order]
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            blobs = [_packed(keys[a:b]) for a, b in pairwise([*cuts.tolist(), len(keys)])]
            many, longs = len(blobs), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(many, number)), pa.array(of[cuts]), pa.array(blobs, pa.binary()), pa.nulls(many, longs), pa.nulls(many, longs)], names=names)
            text = zlib.compress(b"".join(texts), 1)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.array([text], pa.binary()), pa.array([ids], longs), pa.array([[len(t) for t in texts]], longs)], names=names)

        ids, texts, total = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append((text or "").encode())
                total += len(texts[-1])
                if total >= FLUSH_BYTES:
                    yield from made(ids, texts)
                    number += 1
                    ids, texts, total = [], [], 0
        if ids:
            yield from made(ids, texts)

    return run


def _answered(top):
    """Rows sorted by bucket, its counts before its questions, to the log10 probabilities asked for."""

    def run(batches):
        now, parts, tree = None, [], None
        for batch in batches:
            for bucket, asks, part in _runs(batch):
                if bucket != now:
                    now, parts, tree = bucket, [], None
                if not asks:
                    parts.append(part)
                    continue
                if tree is None:
                    known, tree = _subtree(parts)
                    logs, parts = tree.log10(known, top.value), []
                out = []
                for blob in part.column(4).to_pylist():
                    keys = _unpacked(blob)
                    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                    new = known[at] != keys if len(known) else np.ones(len(keys), dtype=bool)
                    answer = logs[at] if len(known) else np.zeros(len(keys))
                    answer[new] = tree.log10(keys[new], top.value)
                    out.append(answer.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(0), pa.array(out, pa.binary())], names=["batch", "bucket", "logs"])

    return run


def _scores(buckets, frequent):
    """A batch's documents and answers to a row a document (``h`` null) and one for each token that is not frequent."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, logs = frequent.value
        names = ["doc_id", "mark", "h", "n_tokens", "n_known", "base", "score", "n_bytes"]
        (row,) = docs.to_pylist()
        ids, text = pa.array(row["ids"], pa.int64()), zlib.decompress(row["blob"])
        texts = [text[a:b] for a, b in pairwise([0, *np.cumsum(row["sizes"]).tolist()])]
        every = _grams(texts, DEPTH)
        asked = distinct(every)
        place = pd.Index(asked).get_indexer(every)
        order = np.argsort(_bucket(asked, buckets), kind="stable")
        each = np.empty(len(asked))
        each[order] = np.frombuffer(b"".join(answers.sort_by("bucket").column("logs").to_pylist()), dtype=np.float32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        score = np.add.reduceat(each[place], np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]))
        hashes = [np.append(_hashes(t), np.uint64(_END)) for t in texts]
        many = np.array([len(h) for h in hashes])
        doc = np.repeat(np.arange(len(texts)), many)
        h = np.concatenate(hashes)
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
        base = np.bincount(doc, weights=np.where(hit, logs[at] if len(keys) else 0.0, 0.0), minlength=len(texts))
        known = np.bincount(doc, weights=hit, minlength=len(texts)).astype(np.int64)
        mark = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
        own = pa.Table.from_arrays([ids, pa.array(mark), pa.nulls(len(texts), pa.int64()), pa.array(many.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), pa.array(lengths)], names=names)
        rest = np.nonzero(~hit)[0]
        nulls = [pa.nulls(len(rest), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
        more = pa.Table.from_arrays([ids.take(pa.array(doc[rest])), pa.array(mark[doc[rest]]), pa.array(h[rest].view(np.int64)), *nulls], names=names)
        return pa.concat_tables([own, more])

    return run


def learn(train: DataFrame) -> DataFrame:
    """``(kind, key, n)`` over all rows of ``train(text)``, stored in the shared folder."""
    return stored(train.select(F.col("text").cast("string")).mapInArrow(_counts(DEPTH), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _most(sizes: list, limit: int) -> int:
    """The least power of two (as its exponent) such that at most ``limit`` counts reach it."""
    least, have = 64, 0
    for r in sorted(sizes, key=lambda r: -r.size):
        if have + r.v > limit:
            break
        least, have = r.size, have + r.v
    return least


def _risen_top(dealt: DataFrame) -> Tree:
    """The tree down to depth ``TOP``, from the counts by bucket."""
    risen = dealt.mapInArrow(_risen, "bit byte, at long, weight double").groupBy("bit", "at").agg(F.sum("weight").alias("weight")).toPandas().sort_values(["bit", "at"])
    by_bit = [(own["at"].to_numpy(dtype=np.int64), own["weight"].to_numpy(dtype=np.float64)) for own in (risen[risen["bit"] == k] for k in range(9))]
    return Tree(*by_bit[8], 0, TOP, by_bit[:8])


def score(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row."""
    spark = docs.sparkSession
    release(spark)
    grams = counts.where("kind = 0")
    n_grams = grams.count()
    buckets = 1 << max(8, (n_grams // PER_BUCKET).bit_length())
    width = partitions(spark, n_grams, 1 << 18)
    nothing = lambda t: F.lit(None).cast(t)
    known = grams.select(_bucket_of(F.col("key"), buckets).alias("bucket"), "key", "n", nothing("long").alias("batch"), nothing("binary").alias("blob"))
    upper = _risen_top(known.repartition(width, "bucket").sortWithinPartitions("bucket"))
    tokens = counts.where("kind = 1")
    size = F.floor(F.log2("n")).cast("int")
    by_size = tokens.groupBy(size.alias("size")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # at most 64 rows
    total, kinds = sum(r.n for r in by_size), sum(r.v for r in by_size)
    least = _most(by_size, FREQUENT)
    have = any(r.size >= least for r in by_size)
    top = tokens.where(size >= least).select("key", "n").toPandas() if have else None
    if have:
        keys = top["key"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        frequent = (keys[order], np.log10(top["n"].to_numpy(dtype=np.float64)[order] + 1))
    else:
        frequent = (np.zeros(0, dtype=np.uint64), np.zeros(0))
    sc = spark.sparkContext
    asked = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_asked(buckets), "batch long, bucket long, blob binary, ids array<long>, sizes array<long>"))
    release(spark)
    questions = asked.where("bucket IS NOT NULL").select("bucket", nothing("long").alias("key"), nothing("long").alias("n"), "batch", "blob")
    dealt = known.union(questions).repartition(width, "bucket").sortWithinPartitions("bucket", F.col("batch").asc_nulls_first())
    answers = dealt.mapInArrow(_answered(sc.broadcast(upper)), "batch long, bucket long, logs binary")
    texts = asked.where("bucket IS NULL").select("batch", "blob", "ids", "sizes")
    schema = "doc_id long, mark long, h long, n_tokens long, n_known long, base double, score double, n_bytes long"
    rows = stored(texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scores(buckets, sc.broadcast(frequent)), schema))
    release(spark)
    rest = tokens.where(size < least).select(F.col("key").alias("h"), "n")
    joined = rows.where("h IS NOT NULL").select("doc_id", "mark", "h").join(rest, "h").groupBy("doc_id", "mark").agg(F.count("*").alias("n_known"), F.sum(F.log10(F.col("n") + 1)).alias("base"))
    own = rows.where("h IS NULL")
    parts = own.select("doc_id", "mark", F.lit(1).cast("long").alias("rows"), "n_tokens", "n_known", "base", "score", "n_bytes", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("b"))
    more = joined.select("doc_id", "mark", F.lit(0).cast("long"), *[F.lit(None).cast(t) for t in ("long", "long", "double", "double", "long")], F.col("n_known"), F.col("base"))
    made = parts.union(more).groupBy("doc_id", "mark").agg(F.sum("rows").alias("rows"), *[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")], F.sum("k").alias("k"), F.sum("b").alias("b"))
    made = made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    out = made.select(
        "doc_id", "n_tokens", (F.col("n_known") + (F.col("k") / F.col("rows")).cast("long")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("b") / F.col("rows") - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"),
        "score", (-F.col("score") / np.log10(2.0) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
    release(spark)
    return out


def op9_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id") % 7 == 2
    scored = score(docs, learn(docs.where(~F.coalesce(held_out, F.lit(False)))))
    return scored.select("doc_id", F.coalesce(fold("doc_id") % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
