"""Shared pieces of the training-data operators: inputs, shared storage, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; ``bytes.split()`` splits on the same six bytes.
FEW = 10_000  #: edges that one task unites
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on one machine whose session names none."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="wordloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: lineage ends there, lost executors cost nothing."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (columnar, compressed)."""
    spark = df.sparkSession
    path = f"{ensure_shared_dir(spark).rstrip('/')}/wordloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote; only for tables that no later plan reads."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted (by sorting: several times as fast as hashing them)."""
    own = np.sort(values)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def packed40(values: np.ndarray) -> bytes:
    """The low five bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked40(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def runs(batches, keys: list[str]):
    """Record batches sorted by ``keys`` to one table a key."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        mark = np.stack([part[k].to_numpy() for k in keys])
        cuts = [0, *(np.nonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0))[0] + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(mark[:, a].tolist())
            if held and key != last:
                yield last, pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield last, pa.concat_tables(held)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of plans that nothing refers to."""
    for _ in range(2):  # the cleaner works through a queue that a first collection fills
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Partitions for ``rows`` at about ``per`` rows each, at least the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def fold(key: str | Column) -> Column:
    """crc32 of an id written as text, the basis of every held-out split."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))



def _united(batches):
    """All of a few edges to ``(id, component_id)``."""
    root: dict = {}

    def find(i):
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    names, schema = ["id", "component_id"], None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    if schema is not None:
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array([find(i) for i in ids], schema.field(1).type)], names=names)


def components(edges: DataFrame, limit: int = 60, few: int = FEW) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component_id)``, the smallest id of each.

    Alternates large-star and small-star steps, so a chain of n links needs O(log n) rounds and
    the number of edges never grows.  Each round is one aggregate and one join on the node, both
    of which Spark can pre-aggregate or split when one node has very many links, and ends in a
    checkpoint.  Only two numbers a round come to the driver.  At most ``few`` edges are united by
    one task instead, with the same result.  Ids without an edge are not returned.
    """
    spark = edges.sparkSession
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(state)
    if 0 < before[0] <= few:
        kind = state.schema["a"].dataType.simpleString()
        return cut(state.coalesce(1).mapInArrow(_united, f"id {kind}, component_id {kind}"))
    for _ in range(limit):
        if before[0] == 0:
            break
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = _mark(new)
        state = new
        if after == before:
            break
        before = after
        release(spark)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    ids = state.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return ids.unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row.n, row.x
