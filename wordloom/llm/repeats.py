"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of one document; a word goes if a window covers it whose
word sequence also starts in a document with a smaller id.  Every window holds exactly one whole
block of ``window // 2 + 1`` words that starts at a multiple of that length, so:

1. index: each document's non-overlapping blocks; probe: the same number of words at every
   position.  A block is hot if it is indexed and at least two documents hold it somewhere.
2. extend: around every hot hit, the full windows that hold it (only there can a repeat start) are
   named by a 128-bit digest of their words, and the smallest id that has each is found.
3. every document removes the words that windows owned by a smaller id cover, which is the union
   of its maximal repeats.

Probes and digests travel as packed arrays, one row for each flush of a task and hash range: 5 bytes
of hash (12 of digest) and 2 of document number.  A false hit of step 1 only costs a window in step
2.  Texts travel compressed.  Each flush settles what it can by itself: of a hash that is hot within
it, and of a window that several of its documents have, one document's entry goes on.  So a passage
that very many documents share meets as one entry a flush, and no pairs are made.  The number of ranges follows the number of input partitions, so what one range
gathers does not grow with the corpus.

Null, empty and blank texts have no words (``n_words`` 0 and the digest of no bytes).  Rows that
share a doc_id, with equal or different texts, are judged each by its own text, and only a smaller
id removes.  A null id is no smaller
than any other and owns nothing.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed40, release, stored, table, unpacked40

WINDOW = 13
MANY = 64  #: entries of a hash in one flush that make it hot without an indexed block
FLUSH_WORDS, FLUSH_DOCS = 2_000_000, 60_000  #: a task's packed arrays are sent off at this size
PACKED = "range int, ids binary, docs binary, keys binary, extra binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def rolling(words: list[bytes], block: int) -> np.ndarray:
    """A hash for the ``block`` words at every position that has as many."""
    n = len(words) - block + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(block):
        out = out * _ODD + own[k : k + n]
    out ^= out >> np.uint64(29)
    out *= _ODD
    return out ^ (out >> np.uint64(32))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def _dealt(ids: np.ndarray, docs: np.ndarray, to: np.ndarray, keys: np.ndarray, pack, extra: np.ndarray, pack_extra):
    """Rows of ``PACKED`` from arrays of entries; ``docs``: the row of ``ids`` of each, ``to``: its range."""
    order = np.argsort(to, kind="stable")
    keys, extra, docs, to = keys[order], extra[order], docs[order], to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, dtype=np.int64)
    rows = []
    for i, j in zip(cuts, [*cuts[1:], len(to)]):
        here, number = np.unique(docs[i:j], return_inverse=True)
        rows.append((int(to[i]), ids[here].tobytes(), number.astype(np.uint16).tobytes(), pack(keys[i:j]), pack_extra(extra[i:j])))
    for i in range(0, len(rows), 32):
        yield _batch(rows[i : i + 32], ["range", "ids", "docs", "keys", "extra"], [pa.int32(), *[pa.binary()] * 4])


def _owners(ids: bytes, docs: bytes, width: int = 1) -> np.ndarray:
    return np.frombuffer(ids, dtype=np.int64).reshape(-1, width)[np.frombuffer(docs, dtype=np.uint16)]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _aside(ranges: int, flush: int) -> int:
    """The range above all others that takes what a flush has settled by itself."""
    return ranges + xxhash.xxh32_intdigest(f"{TaskContext.get().partitionId()} {flush}") % ranges


def _settled(h: np.ndarray, d: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a flush tells of its own hashes: order, hits settled, entries sent on, and their anchors.

    A hash that two documents of the flush hold, one of them in an indexed block, is hot whatever
    others hold; so is taken one with ``MANY`` entries (a false hit only costs a window).  Of such a
    hash one entry goes on, so a passage of very many documents meets as one entry a flush.
    """
    order = np.argsort(h, kind="stable")
    h, d, anchors = h[order], d[order], anchors[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(first, len(h)))
    indexed = np.logical_or.reduceat(anchors, first)
    done = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) & (indexed | (sizes >= MANY))
    settled = np.repeat(done, sizes)
    on = ~settled
    on[first] = True
    anchors[first[done]] = indexed[done]
    return order, settled, on, anchors


def _probes(block: int, ranges: int):
    """Step 1, map side: rolling hashes by range; ``extra`` tells which are indexed."""

    def run(batches):
        held: list[np.ndarray] = []
        ids: list[int] = []
        total, number = 0, 0

        def flush():
            if total:
                h = np.concatenate(held)
                anchors = np.concatenate([np.arange(len(x)) % block == 0 for x in held])
                docs, own = np.repeat(np.arange(len(ids)), [len(x) for x in held]), np.array(ids, dtype=np.int64)
                order, settled, on, anchors = _settled(h, own[docs], anchors)
                h, docs = h[order], docs[order]
                to = ((h >> np.uint64(44)) % np.uint64(ranges)).astype(np.int64)
                yield from _dealt(own, docs[on], to[on], h[on], packed40, anchors[on], _bits)
                yield from _dealt(own, docs[settled], np.full(int(settled.sum()), _aside(ranges, number)), h[settled], packed40, anchors[settled], _bits)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = rolling(_words(text), block)
                if len(h):
                    held.append(h)
                    ids.append(doc)
                    total += len(h)
                if total >= FLUSH_WORDS or len(ids) >= FLUSH_DOCS:
                    yield from flush()
                    held, ids, total, number = [], [], 0, number + 1
        yield from flush()

    return run


def _by_doc(d: np.ndarray, keys: np.ndarray, pack) -> pa.Table:
    order = np.argsort(d, kind="stable")
    d, keys = d[order], keys[order]
    owners, first = np.unique(d, return_index=True)
    ends = [*first.tolist(), len(d)]
    return pa.table({"doc_id": pa.array(owners, pa.int64()), "hits": pa.array([pack(keys[i:j]) for i, j in zip(ends, ends[1:])], pa.binary())})


def _hot(ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        """Step 1, one range: ``(doc_id, hashes)`` of hot blocks."""
        hashes, ids, anchors = [], [], []
        for own, docs, packed, indexed in zip(*(rows[c].to_pylist() for c in ("ids", "docs", "keys", "extra"))):
            h = unpacked40(packed)
            hashes.append(h)
            ids.append(_owners(own, docs)[:, 0])
            anchors.append(np.unpackbits(np.frombuffer(indexed, dtype=np.uint8), count=len(h)).astype(bool))
        h, d, a = np.concatenate(hashes), np.concatenate(ids), np.concatenate(anchors)
        if rows["range"][0].as_py() >= ranges:  # settled by the flush
            return _by_doc(d, h, packed40)
        order = np.lexsort((d, h))
        h, d, a = h[order], d[order], a[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(h)) - 1
        hot = (d[first] != d[last]) & np.logical_or.reduceat(a, first)
        keep = hot[group]
        keep[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return _by_doc(d[keep], h[keep], packed40)

    return run


def _not_first(keys: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, and which entries of that order a smaller id has too."""
    order = np.lexsort((d, keys[:, 0], keys[:, 1], keys[:, 2]))
    keys, d = keys[order], d[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return order, d > d[np.nonzero(new)[0]][np.cumsum(new) - 1]


def _first_owner(ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        """Step 2, one range: ``(doc_id: the row's number, window starts)`` of windows that a smaller id has too."""
        keys = np.concatenate([np.frombuffer(b, dtype="<u4").reshape(-1, 3) for b in rows["keys"].to_pylist()])
        own = np.concatenate([_owners(a, b, 2) for a, b in zip(rows["ids"].to_pylist(), rows["docs"].to_pylist())])
        at = np.concatenate([np.frombuffer(b, dtype="<u4") for b in rows["extra"].to_pylist()])
        if rows["range"][0].as_py() < ranges:  # others are settled by the flush
            order, gone = _not_first(keys, own[:, 0])
            own, at = own[order][gone], at[order][gone]
        return _by_doc(own[:, 1], at, lambda x: np.sort(x).astype("<u4").tobytes())

    return run


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n word positions the windows at these starts cover."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark[:n]) > 0


def _sha(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _extend(block: int, window: int):
    """Step 2, map side: documents and their hits; without a candidate window a document is done."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_words", "kept_sha256", "text", "digests", "starts"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for doc, blob, hits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = unpack.decompress(blob).split()
                starts = np.zeros(0, dtype=np.int64)
                if hits and len(words) >= window:
                    low = rolling(words, block) & np.uint64((1 << 40) - 1)
                    at = np.nonzero(np.isin(low, unpacked40(b"".join(hits))))[0]
                    mark = np.zeros(len(words) + window, dtype=np.int64)
                    np.add.at(mark, np.maximum(at - (window - block), 0), 1)
                    np.add.at(mark, at + 1, -1)
                    starts = np.nonzero(np.cumsum(mark)[: len(words) - window + 1] > 0)[0]
                if len(starts):
                    digest = xxhash.xxh3_128_digest
                    digests = b"".join(digest(b" ".join(words[i : i + window]))[:12] for i in starts.tolist())
                    out.append((doc, len(words), None, blob, digests, starts.astype("<u4").tobytes()))
                else:
                    out.append((doc, len(words), _sha(words), None, None, None))
                if len(out) >= 500:
                    yield _batch(out, names, kinds)
                    out = []
            yield _batch(out, names, kinds)

    return run


def _window_rows(ranges: int):
    """Step 2, map side: windows by range; of a flush's windows only those of its smallest id go on."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[tuple[int, int]] = []
        total, number = 0, 0

        def flush():
            if total:
                keys, at = np.concatenate([k for k, _ in held]), np.concatenate([a for _, a in held])
                docs, own = np.repeat(np.arange(len(ids)), [len(a) for _, a in held]), np.array(ids, dtype=np.int64)
                order, gone = _not_first(keys, own[docs, 0])
                keys, at, docs = keys[order], at[order], docs[order]
                to = np.where(gone, _aside(ranges, number), keys[:, 0].astype(np.int64) % ranges)
                yield from _dealt(own, docs, to, keys, np.ndarray.tobytes, at, np.ndarray.tobytes)

        for batch in batches:
            for doc, row, digests, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append((np.frombuffer(digests, dtype="<u4").reshape(-1, 3), np.frombuffer(starts, dtype="<u4")))
                ids.append((doc, row))
                total += len(held[-1][1])
                if total >= FLUSH_WORDS or len(ids) >= FLUSH_DOCS:
                    yield from flush()
                    held, ids, total, number = [], [], 0, number + 1
        yield from flush()

    return run


def _remove(window: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, n, blob, owned in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, removed = unpack.decompress(blob).split(), 0
                if owned:
                    gone = _covered(np.frombuffer(b"".join(owned), dtype="<u4").astype(np.int64), window, n)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc, n, removed, _sha(words)))
            yield _batch(out, ["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return run


def _compressed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["doc_id", "text"])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    spark = docs.sparkSession
    block = window // 2 + 1
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranges = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    probes = docs.where("doc_id IS NOT NULL").mapInArrow(_probes(block, ranges), PACKED)
    hits = stored(probes.groupBy("range").applyInArrow(_hot(ranges), "doc_id long, hits binary"))
    del probes
    release(spark)
    by_doc = hits.groupBy("doc_id").agg(F.collect_list("hits").alias("hits"))  # at most a document's own words
    joined = docs.mapInArrow(_compressed, "doc_id long, text binary").join(by_doc, "doc_id", "left").select("doc_id", "text", "hits")
    extended = joined.mapInArrow(_extend(block, window), "doc_id long, n_words long, kept_sha256 string, text binary, digests binary, starts binary")
    state = stored(extended.withColumn("row", F.monotonically_increasing_id()))  # names a row where ids repeat
    del joined, by_doc, hits
    release(spark)
    met = state.where("digests IS NOT NULL")
    rows = met.select("doc_id", "row", "digests", "starts").mapInArrow(_window_rows(ranges), PACKED)
    owned = stored(rows.groupBy("range").applyInArrow(_first_owner(ranges), "doc_id long, hits binary"))
    del rows
    release(spark)
    owned = owned.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list("hits").alias("owned"))
    cleaned = met.select("doc_id", "row", "n_words", "text").join(owned, "row", "left").select("doc_id", "n_words", "text", "owned")
    cleaned = cleaned.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    whole = state.where("digests IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.unionByName(cleaned)


def op7_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def oracle(window: int = WINDOW) -> str:
    """The same rows in DuckDB SQL, by grouping every window's words (ids are taken to be unique)."""
    return f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {window}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(len(ws) - {window - 1})) AS i FROM w WHERE len(ws) >= {window})),
    f AS (SELECT s, min(doc_id) AS owner FROM g GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM (SELECT DISTINCT g.doc_id, g.i FROM g JOIN f ON f.s = g.s WHERE f.owner < g.doc_id)),
    left_ AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM (SELECT doc_id, i AS p, ws[i + 1] AS word FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w)) p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p WHERE gone.p IS NULL GROUP BY p.doc_id)
    SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256 FROM w LEFT JOIN left_ l ON l.doc_id = w.doc_id"""
