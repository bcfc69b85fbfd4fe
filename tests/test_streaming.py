from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wordloom.streaming import live


def _run(spark, tmp_path, build):
    begin = datetime(2024, 1, 1)
    at = [0, 1, 2, 30, 31, 90, 200]
    for part, hours in enumerate((at[:3], at[3:5], at[5:6], at[6:])):  # a file a micro-batch
        spark.createDataFrame([(1, begin + timedelta(hours=h), float(h)) for h in hours], "source long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")), build(spark.read.parquet(str(tmp_path / "in")))


def test_final_spans_are_those_of_the_table(spark, tmp_path):
    live_, whole = _run(spark, tmp_path, live.spans)
    got, want = ({tuple(r) for r in d.collect()} for d in (live_, whole))
    assert got <= want and {r[3] for r in want} == {3, 2, 1} and len(want) - len(got) <= 1


def test_final_levels_are_those_of_the_table(spark, tmp_path):
    live_, whole = _run(spark, tmp_path, lambda d: live.levels(d, "10 hours"))
    got, want = ({tuple(r) for r in d.select("source", "start", F.round("rms", 6), "n").collect()} for d in (live_, whole))
    assert got <= want and len(want) - len(got) <= 1
