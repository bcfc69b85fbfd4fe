"""Best-fit packing planned on a length histogram.

Texts become token ids, an end id closes each, and only what is longer than ``size`` is cut, into
pieces of ``size`` with the remainder first.  The plan sees nothing but how many pieces there are of
each length (at most ``size`` numbers, whatever the corpus): best-fit decreasing runs over whole
counts, taking runs of sequences with equal room at a time.  Its output gives, for each length and
range of ranks, the run of sequences and the offset.  Pieces then take their slots by rank within
their length; the rank is a running number inside a (length, salt) group plus the number of pieces
of that length in smaller salts, so no length meets in one task.

Null and empty texts are one end id.  Repeated rows are packed once each: equal pieces are
interchangeable.  Rows with a null id are packed like others.  An empty table gives no rows.  Of
other columns, whatever their names, ``pieces`` reads none; ``pack`` keeps those of its input.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SIZE = 1024
END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """``text -> ids`` as the tokenizers library gives them for this byte-level BPE file.

    tiktoken runs the file's own vocabulary with the file's own merge order, which is several
    times as fast; a text that holds one of the special tokens' strings, or that it cannot split,
    goes to the library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    specials = [t["content"] for t in model["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(char[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in specials}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        if not any(s in text for s in specials):
            try:
                return fast.encode_ordinary(text)
            except BaseException as error:  # its pattern engine panics on a very long run of white space
                if type(error).__name__ != "PanicException":
                    raise
        return slow().encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.  ``tokenizer``: a name or path."""
    name = tokenizer or "byte_bpe_50k.json"

    def run(batches):
        import public_tokenizers

        encode = _encoder(name if "/" in name else public_tokenizers.path(name))
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                at, n = 0, len(ids) % size or size
                for piece in range(-(-len(ids) // size)):
                    out.append((doc, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at, n = at + n, size
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts.

    Returns slot runs ``(length, first_rank, n, first_sequence, offset)`` sorted by length and
    rank, and the number of sequences.  Sequences with equal room are held as runs of consecutive
    numbers; a length fills the tightest run first, each sequence of it as often as it fits,
    because the room left after one piece is the tightest for the next.
    """
    room: list[tuple[int, int, int]] = []  # (room left, first sequence, how many), sorted
    slots: list[tuple[int, int, int, int, int]] = []
    used = 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(room, (length, -1, -1))
            if at < len(room):
                free, first, many = room.pop(at)
            else:
                fit = size // length
                free, first, many = size, used, -(-left // fit)
                used += many
            fit = free // length
            full = min(many, left // fit)
            for j in range(fit if full else 0):
                slots.append((length, rank, full, first, size - free + j * length))
                rank += full
            left -= full * fit
            rest = free - fit * length
            if full and rest:
                insort(room, (rest, first, full))
            first, many = first + full, many - full
            if many and left and left < fit:
                for j in range(left):
                    slots.append((length, rank + j, 1, first, size - free + j * length))
                rest = free - left * length
                if rest:
                    insort(room, (rest, first, 1))
                left, first, many = 0, first + 1, many - 1
            if many:
                insort(room, (free, first, many))
    slots.sort()
    return np.array(slots, dtype=np.int64).reshape(-1, 5), used


def pack(parts: DataFrame, size: int = SIZE, per_salt: int = 2_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``."""
    spark = parts.sparkSession
    parts = cut(parts)
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots, _ = plan(histogram, size)
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, many in histogram.items() for x in (n, -(-many // per_salt))]), F.col("length").cast("int")), F.lit(1)) if histogram else F.lit(1)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = [c for c in parts.columns]
    held = spark.sparkContext.broadcast(slots)  # at most about two runs for each pair of lengths, however many pieces

    def run(batches):
        runs = held.value
        keys = (runs[:, 0] << 40) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 40) + rank, side="right") - 1
            picked = runs[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(picked[:, 3] + rank - picked[:, 1]), pa.array(picked[:, 4])], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(run, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
