"""Sources, edit lists, scripts, takes and verdicts on small inputs."""

import json
import random
import struct
import wave
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wordloom.functions import media
from wordloom.operators import judge, script, takes
from wordloom.sources import artifacts, editlist


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_artifacts_round_trip_and_reject_other_shapes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "i int, w string, conf double")
    artifacts.write(rows, str(tmp_path / "words"), F.struct(F.lit("words").alias("stage"), F.lit(1).alias("stage_version")))
    back = artifacts.read(spark, str(tmp_path / "words"), "struct<i:int,w:string,conf:double>").select("meta.stage", "data.*")
    assert sorted(map(tuple, back.collect()), key=str) == [("words", 1, "a", 0.5), ("words", 2, None, None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"meta": {"stage_version": "no"}, "data": 3')
    with pytest.raises(Exception):
        artifacts.read(spark, str(tmp_path / "bad"), "struct<i:int>").collect()


def test_listing_is_natural_and_skips_hidden(spark, tmp_path):
    for name in ("take10.MOV", "take2.mov", ".take1.mov", "notes.txt", "Take1.mp4"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in artifacts.listing(spark, str(tmp_path)).orderBy("key").collect()] == ["Take1.mp4", "take2.mov", "take10.MOV"]


def test_wav_samples_are_mixed_to_mono(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(1000)
        out.writeframes(b"".join(struct.pack("<hh", 16384, 0) for _ in range(25)))
    series = artifacts.samples(spark, str(tmp_path))
    assert series.count() == 25 and {r.value for r in series.collect()} == {0.25}
    assert sorted((r.frame, r.rms) for r in artifacts.rms(series).collect()) == [(0, 0.25), (1, 0.25), (2, 0.25)]


def test_edit_list_round_trip(spark):
    ranges = spark.createDataFrame([("p", 1, 7, 30, 90), ("p", 2, 8, 0, 45), ("p", 3, 7, 120, 121)], "project string, n long, source long, in_frame long, out_frame long")
    assets = spark.createDataFrame([("p", 7, "/raw/a & b+1.mov", 108000), ("p", 8, "/raw/c.mov", 0), ("q", 9, "/raw/d.mov", 0)], "project string, source long, path string, start_frames long")
    documents = editlist.written(ranges, assets, 30000, 1001)
    assert documents.count() == 2
    got = [(r.n, r.name, Fraction(r.in_num, r.in_den), Fraction(r.out_num, r.out_den)) for r in editlist.parsed(documents.where("project = 'p'")).orderBy("n").collect()]
    tick = Fraction(1001, 30000)
    assert got == [(0, "a & b+1.mov", 30 * tick, 90 * tick), (1, "c.mov", Fraction(0), 45 * tick), (2, "a & b+1.mov", 120 * tick, 121 * tick)]


def test_times_and_names(spark):
    parsed = lambda t: one(spark, F.struct(*media.parsed_time(F.lit(t))))
    assert tuple(parsed("1001/30000s")) == (1001, 30000) and tuple(parsed("12.5s")) == (125, 10) and tuple(parsed("0s")) == (0, 1)
    with pytest.raises(Exception):
        parsed("12")
    assert one(spark, media.uri_name(media.file_uri(F.lit("/x y/ä+%.mov")))) == "ä+%.mov"
    assert abs(one(spark, media.confidence(F.array(F.lit(0.25), F.lit(1.0)))) - 0.5) < 1e-12
    assert one(spark, media.confidence(F.array(F.lit(0.25), F.lit(None).cast("double")))) is None


def test_script_fences_and_chapters(spark):
    text = "---\na: 1.\n...\nBefore. \n# One\nFirst *line*\ngoes on. Second!\n~~~\n```\nno.\n~~~\nAfter the fence.\n### Deep\nStill one.\n## Two\n![alt.](x) end"
    rows = script.parsed(spark.createDataFrame([(1, text)], "script long, text string"), F.col("text")).orderBy("sentence").collect()
    assert [(r.chapter, r.sentence, r.text) for r in rows] == [(None, 1, "Before."), ("One", 2, "First line goes on."), ("One", 3, "Second!"), ("One", 4, "After the fence."), ("One", 5, "Still one."), ("Two", 6, "alt. end")]


def _overlap(a, b):
    return a[2] <= b[3] and b[2] <= a[3]


def test_take_choices_match_brute_force(spark):
    rng = random.Random(6)
    rows = {(p, rng.randrange(4), a, a + rng.randrange(6), float(rng.randrange(80, 86))) for p in range(6) for a in (rng.randrange(40) for _ in range(9))}
    df = spark.createDataFrame(sorted(rows), "project long, sentence long, first_word long, last_word long, score double")
    want = []
    for key in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[4], -r[2], -r[3])):
            if not any(_overlap(r, o) for o in kept):
                kept.append(r)
        want += kept
    assert sorted(map(tuple, takes.suppressed(df).collect())) == sorted(want)

    def paths(left, after=-1, end=-1):
        yield []
        for r in left:
            if r[1] > after and r[2] > end:
                for rest in paths(left, r[1], r[3]):
                    yield [r, *rest]

    got = {}
    for r in takes.monotone(df).collect():
        got.setdefault(r.project, []).append(tuple(r))
    for p in range(6):
        best = max(paths([r for r in rows if r[0] == p]), key=lambda c: (sum(r[4] for r in c), tuple(-r[1] for r in c), tuple(r[2] for r in c)))
        assert got[p] == best


def test_verdicts(spark):
    reply = lambda **r: json.dumps(r)
    decisions = spark.createDataFrame([(k, "drop", True, "long_segment") for k in range(7)] + [(7, "drop", False, "long_segment")], "id long, action string, flagged boolean, flag_reason string")
    replies = [(0, reply(choice="A", confidence=0.9, reason="r")), (1, reply(choice="B", confidence=0.7, reason="r")), (2, reply(choice="both", confidence=1, reason="r")), (3, reply(choice="B", confidence=0.5, reason="r")), (4, reply(choice="C", confidence=0.9, reason="r")), (5, "no json"), (7, reply(choice="both", confidence=0.9, reason=""))]
    replies = spark.createDataFrame(replies, "id long, reply string")
    got = {r.id: (r.action, r.flagged, r.flag_reason) for r in judge.applied(decisions, replies).collect()}
    same = ("drop", True, "long_segment")
    assert got == {0: ("keep", True, "judge_prefers_first_take"), 1: ("drop", False, None), 2: ("keep", False, None), 3: ("keep", True, "long_segment"), 4: same, 5: same, 6: same, 7: ("drop", False, "long_segment")}
    assert {(r.action, r.flagged) for r in judge.applied(decisions, replies, F.lit(False)).collect()} == {("drop", True), ("drop", False)}
