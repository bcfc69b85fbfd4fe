"""Readers and writers of stage artifacts, raw folders and sampled audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

META = "struct<stage:string,stage_version:int,inputs_hash:string,config_hash:string,created_at:string>"


def read(spark: SparkSession, path: str, data: str | StructType) -> DataFrame:
    """Artifacts ``{"meta": ..., "data": ...}``, one document a file, with a fixed schema; malformed ones raise."""
    shape = data.simpleString() if isinstance(data, StructType) else data
    return spark.read.schema(f"meta {META}, data {shape}").option("multiLine", True).option("mode", "FAILFAST").json(path)


def write(df: DataFrame, path: str, meta: Column) -> None:
    """The rows of ``df`` as ``data`` of one artifact a row."""
    df.select(meta.alias("meta"), F.struct(*df.columns).alias("data")).write.mode("overwrite").json(path)


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("mov", "mp4")) -> DataFrame:
    """``path, name, size, modified, key`` of a folder's visible files with these suffixes (any case).

    ``key`` sorts names naturally (digit runs as numbers).  Only metadata is read.  A folder without
    such a file gives no rows; a missing one raises.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).where(~F.col("name").startswith(".") & F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes))
    return files.select("path", "name", "size", "modified", T.natural_key(F.col("name")).alias("key"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """``path, rate, k, value``: 16-bit PCM WAV files mixed to mono by the mean of their channels, -1 to 1.

    One file is one task's input; its samples leave in batches.
    """
    import io
    import wave

    import numpy as np
    import pandas as pd

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with wave.open(io.BytesIO(content)) as held:
                    rate, channels, at = held.getframerate(), held.getnchannels(), 0
                    while raw := held.readframes(65536):
                        value = np.frombuffer(raw, dtype="<i2").reshape(-1, channels).mean(axis=1) / 32768.0
                        yield pd.DataFrame({"path": path, "rate": rate, "k": np.arange(at, at + len(value)), "value": value})
                        at += len(value)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "path string, rate long, k long, value double")


def rms(series: DataFrame, frame_ms: int = 10) -> DataFrame:
    """``path, frame, rms``: tumbling frames of ``frame_ms`` (the last one short)."""
    frame = F.call_function("div", F.col("k") * 1000, F.col("rate") * frame_ms)
    return series.groupBy("path", frame.alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
