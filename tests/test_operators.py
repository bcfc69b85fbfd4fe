"""Operators of the engine on small relations."""

import random

import numpy as np
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.functions import timing
from wordloom.operators import fillers, intervals, islands, repeats, scoring, signal, timeline
from wordloom.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_functions(spark):
    assert one(spark, T.normal(F.lit("“Don't,”"))) == "dont"
    assert one(spark, T.normal(F.lit("$5!"))) == "$5"
    assert one(spark, T.sentences(F.lit("One. Two? three"))) == ["One.", "Two?", "three"]
    assert one(spark, T.strip_inline(F.lit("![a](b) [c](d) *e* `f`"))) == "a c e f"
    assert abs(one(spark, T.ratio(F.lit("agent"), F.lit("agents"))) - 1000 / 11) < 1e-9
    assert one(spark, T.ratio(F.lit(""), F.lit(""))) == 100.0
    assert one(spark, timing.timecode_frames(F.lit("01:00:00:02"), F.lit(25))) == 90002
    assert one(spark, timing.rational(F.lit(30), F.lit(30000), F.lit(1001))) == "1001/1000s"
    assert one(spark, timing.rational(F.lit(0), F.lit(25), F.lit(1))) == "0s"
    assert one(spark, timing.clamp(F.lit(5), F.lit(9), F.lit(3))) == 9


def test_ratio_is_indel_similarity(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for row in got:
        table = np.zeros((len(row.a) + 1, len(row.b) + 1), int)
        for i, x in enumerate(row.a):
            for j, y in enumerate(row.b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        want = 100.0 if not row.a and not row.b else 200.0 * table[-1, -1] / (len(row.a) + len(row.b))
        assert abs(row.r - want) < 1e-9


def test_union_and_bridge(spark):
    rows = [("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("a", 14, 20), ("b", 1, 2)]
    spans = spark.createDataFrame(rows, "source string, start int, end int")
    assert sorted(map(tuple, islands.union(spans, ["source"]).collect())) == [("a", 0, 12), ("a", 14, 20), ("b", 1, 2)]
    assert sorted(map(tuple, islands.bridge(spans, ["source"], 3).collect())) == [("a", 0, 20), ("b", 1, 2)]


def test_interval_and_as_of_joins_match_loops(spark):
    rng = random.Random(1)
    points = [("s", n, rng.randint(0, 60)) for n in range(40)]
    spans = [("s", n, a, a + rng.randint(0, 30)) for n, a in enumerate(rng.randint(0, 60) for _ in range(15))]
    p, s = spark.createDataFrame(points, "source string, p int, at int"), spark.createDataFrame(spans, "source string, s int, start int, end int")
    got = {(r.p, r.s) for r in intervals.within(p, s, ["source"], "at", "start", "end", 7).collect()}
    assert got == {(n, m) for _, n, t in points for _, m, a, b in spans if a <= t < b}
    marks = s.select("source", F.col("start").alias("mark"), F.col("start").alias("value"))
    for row in intervals.next_at_or_after(p, marks, ["source"], "at", "value", "next").collect():
        assert row.next == min((a for _, _, a, _ in spans if a >= row.at), default=None)
    for row in intervals.last_at_or_before(p, marks, ["source"], "at", "value", "last").collect():
        assert row.last == max((a for _, _, a, _ in spans if a <= row.at), default=None)


def test_rolling_median_and_smoothing_match_numpy(spark):
    level = np.random.default_rng(0).normal(size=80)
    frames = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(level)], "source string, k long, level double")
    for row in signal.rolling_median(frames, 11).collect():
        assert abs(row.median - np.median(level[max(0, row.k - 10) : row.k + 1])) < 1e-12
    for row in signal.smooth(frames, 2).collect():
        assert abs(row.smooth - level[max(0, row.k - 2) : row.k + 3].sum() / 5) < 1e-12


def _words(spark, text, source=0, project=0, step=400):
    rows = [(project, source, i, w, i * step, i * step + 300) for i, w in enumerate(text.split())]
    df = spark.createDataFrame(rows, "project int, source int, i int, w string, start int, end int")
    return df.withColumn("norm", T.normal(F.col("w"))).withColumn("ends", T.ends_sentence(F.col("w"))).withColumn("sent", F.lit(0))


def test_repeats_and_guards(spark):
    words = _words(spark, "this tool builds a page for you this tool builds a page for you quickly today.")
    found = repeats.candidates(words)
    rows = {r.i: r for r in found.collect()}
    assert rows[7].j == 0 and rows[7].matches == 7 and rows[7].mismatches == 0
    claimed = repeats.claims(found).collect()
    assert [(r.j, r.i, r.id) for r in claimed] == [(0, 7, "d001")]
    verdict = {r.i: r for r in repeats.guarded(found, words).collect()}[7]
    assert (verdict.action, verdict.reason) == ("drop", None)
    done = _words(spark, "the build is ready now. the build is ready now maybe later.")
    verdict = {r.i: r for r in repeats.guarded(repeats.candidates(done), done).collect()}[5]
    assert (verdict.action, verdict.reason) == ("keep", "complete_sentence")
    exact = _words(spark, "the build is ready now. the build is ready now.")
    assert {r.i: r for r in repeats.guarded(repeats.candidates(exact), exact).collect()}[5].action == "drop"


def test_a_tolerated_first_mismatch_still_starts_a_run(spark):
    words = _words(spark, "alpha tool builds page fast zeta tool builds page slow")
    assert {(r.i, r.j, r.matches, r.mismatches) for r in repeats.candidates(words).collect()} >= {(5, 0, 3, 1)}


def test_fillers(spark):
    words = _words(spark, "um the uh um plan is er good")
    assert sorted((r.first_word, r.last_word, r.action) for r in fillers.runs(words).collect()) == [(0, 0, "drop"), (2, 3, "drop"), (6, 6, "drop")]
    assert [r.i for r in fillers.openers(words, ["the"]).collect()] == [1]
    assert [(r.first_word, r.last_word) for r in fillers.phrases(words, ["plan", "is"]).collect()] == [(4, 5)]


def test_ranges_cover_kept_words_and_frames_run_on(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(120):
        at += rng.choice([20, 60, 900])
        rows.append((1, i, at, at + 200, rng.random() < 0.2))
        at += 200
    words = spark.createDataFrame(rows, "source long, i int, start int, end int, gone boolean")
    ranges = timeline.group(words, 400, "gone").withColumn("range_no", F.col("range_no").cast("long"))
    cuts = timeline.framed(timeline.cut_points(ranges, words), 25, 1)
    found = cuts.collect()
    for source, i, start, end, gone in rows:
        inside = [r for r in found if r.first_word <= i <= r.last_word]
        assert len(inside) == (0 if gone else 1)
        if not gone:
            assert inside[0].cut_in <= start and end <= inside[0].cut_out
    merged = sorted(timeline.merge_touching(cuts).collect(), key=lambda r: r.in_frame)
    assert all(b.in_frame - a.out_frame > 1 for a, b in zip(merged, merged[1:]))
    tiny = timeline.remove_tiny(cuts, 8, 4).collect()
    assert tiny and all(r.out_frame > r.in_frame for r in tiny)
    offsets = islands.running_offset(cuts.withColumn("n", F.col("out_frame") - F.col("in_frame")), ["source"], ["in_frame"], "n").orderBy("in_frame").collect()
    assert offsets[0].offset == 0 and all(b.offset == a.offset + a.n for a, b in zip(offsets, offsets[1:]))


def test_markers_fall_forward_then_back(spark):
    ranges = spark.createDataFrame([(1, 0, 2, 4), (1, 1, 8, 9)], "source long, range_no long, first_word long, last_word long")
    marks = spark.createDataFrame([(1, 3), (1, 5), (1, 12)], "source long, at_word long")
    assert {r.at_word: r.range_no for r in timeline.attach(marks, ranges).collect()} == {3: 0, 5: 1, 12: 1}


def test_confusion_edge_cases(spark):
    schema = "predicted boolean, gold boolean, unit int"
    row = scoring.confusion(spark.createDataFrame([(False, False, 1)], schema)).first()
    assert (row.precision, row.recall) == (1.0, 1.0)
    row = scoring.confusion(spark.createDataFrame([(False, True, 1), (False, True, 1)], schema)).first()
    assert (row.precision, row.recall, row.f1, row.false_cut_units) == (0.0, 0.0, 0.0, 1)


def test_script_lines_are_sentences_of_an_item(spark, tmp_path):
    spark.createDataFrame([(1, "Well. Is this - it? Yes, it is."), (2, "Yes it is! No.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Is this - it? Yes it is. Never said."), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.line): r.n_sources for r in catalogue.script_missing(spark, str(tmp_path)).collect()}
    assert got == {(7, 0): 1, (7, 1): 2, (7, 2): 0, (8, None): 0}


def test_a_turn_that_restarts_the_turn_before(spark, tmp_path):
    filler = " ".join(f"w{k}" for k in range(100))
    rows = [(1, 1, f"so the tool builds pages {filler} so"), (1, 2, "so the tool builds pages quickly"), (1, 3, "quickly now")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.next_source: (r.n_tail, r.nearest) for r in catalogue.cross_source_repeat(spark, str(tmp_path)).collect()}
    assert got == {2: (106, 0), 3: (6, None)}


def test_fuzzy_pairs_match_all_pairs(spark):
    rng = random.Random(7)
    words = {"".join(rng.choices("abé1", k=rng.randint(1, 15))) for _ in range(40)}
    for word in list(words):
        for _ in range(3):
            own = list(word)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 1)] = rng.choices("abé1", k=rng.randint(0, 1))
            words.add("".join(own))
    v = spark.createDataFrame([(w,) for w in words], "norm string")
    a, b = v.withColumnRenamed("norm", "a"), v.withColumnRenamed("norm", "b")
    want = {(r.a, r.b) for r in a.crossJoin(b).where("a < b AND a <> ''").where(T.ratio(F.col("a"), F.col("b")) >= 85).collect()}
    got = [(r.a, r.b) for r in catalogue.fuzzy_pairs(v).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(len(x) <= 8 for x, _ in want)


def test_split_on_zones_matches_a_plain_loop(spark):
    rng = random.Random(8)
    words, zones, want = [], [], []
    for source in range(6):
        at, made, number = 0, [], 0
        for i in range(60):
            at += rng.choice([20, 100, 300, 700, 900])
            end = at + rng.choice([0, 1, 120, 251])
            number += rng.random() < 0.1
            made.append((source, i, at, end, number))
            at = end
        spots = [(source, t, t + rng.choice([0, 100, 300])) for t in sorted(rng.sample(range(at), 40))] if source else []
        words, zones = words + made, zones + spots
        pieces = [[w for w in made if w[4] == n] for n in sorted({w[4] for w in made})]
        for _, zs, ze in spots:
            parts = []
            for piece in pieces:
                left = [w for w in piece if w[2] + w[3] < 2 * zs]
                right = [w for w in piece if w[2] + w[3] > 2 * ze]
                clear = left and right and len(left) + len(right) == len(piece) and left[-1][3] + 120 <= zs and ze <= right[0][2] - 80
                parts += [left, right] if clear else [piece]
            pieces = parts
        want += [(source, piece[0][1], piece[-1][1]) for piece in pieces]
    w = spark.createDataFrame(words, "source long, i long, start long, end long, range_no long")
    made = timeline.split_on_zones(w, spark.createDataFrame(zones, "source long, zs long, ze long"))
    got = made.groupBy("source", "range_no").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    assert sorted((r.source, r.a, r.b) for r in got.collect()) == sorted(want)
    assert len(want) >= len({(w[0], w[4]) for w in words}) + 10  # zones did split ranges
    assert timeline.split_on_zones(w, spark.createDataFrame([], "source long, zs long, ze long")).select("source", "range_no").distinct().count() == w.select("source", "range_no").distinct().count()


def test_filler_spans_match_a_plain_loop(spark):
    rng = random.Random(21)
    listed, listed_phrases = ["um", "uh", "er"], [["you", "know"], ["um", "you"], ["er", "um", "so"], ["so", "so"], ["know", "um", "you"]]
    rows, want = [], []
    for source in range(8):
        made, sent = [], 0
        for i in range(150):
            made.append((source, i, rng.choice(["um", "uh", "er", "you", "know", "so", "word"]), sent, 400 * i, 400 * i + 300, rng.random() < 0.15))
            sent += rng.random() < 0.25
        rows += made
        kept = [w for w in made if not w[6]]
        sole = [sum(v[3] == w[3] for v in kept) == 1 for w in kept]
        k = 0
        while k < len(kept):
            fit = [n for n in (3, 2) for p in listed_phrases if len(p) == n and [w[2] for w in kept[k : k + n]] == p and not any(sole[k : k + n])]
            to = k
            if not sole[k] and fit:
                to = k + fit[0]
            elif not sole[k]:
                while to < len(kept) and kept[to][2] in listed and not sole[to]:
                    to += 1
            if to > k:
                long_ = kept[to - 1][5] - kept[k][4] > 1500
                want.append((source, kept[k][1], kept[to - 1][1], "phrase" if fit else "run", "keep" if long_ else "drop"))
            k = max(to, k + 1)
    w = spark.createDataFrame(rows, "source long, i long, norm string, sent long, start long, end long, dropped boolean")
    got = fillers.spans(w, listed, listed_phrases, dropped="dropped")
    assert sorted((r.source, r.first_word, r.last_word, r.kind, r.action) for r in got.collect()) == sorted(want)
    assert {"phrase", "run"} == {x[3] for x in want} and {"keep", "drop"} == {x[4] for x in want}
    assert fillers.spans(w.limit(0), listed, listed_phrases).count() == 0
