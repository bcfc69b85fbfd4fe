"""Plans whose cost must grow no faster than the input, with their results against plain loops."""

import random

import duckdb
import pytest

from wordloom.operators import repeats, signal, takes
from wordloom.plans import assembly, catalogue, registry, rules


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def conversations(spark, path, seed=3):
    """Turns over few words, some of which say again what was said before; one is empty, one all of a word."""
    rng = random.Random(seed)
    rows = [(9, 1, "so " * 60), (9, 2, "so so so"), (9, 3, " ")]
    for conv in range(6):
        last = "plan the tool now"
        for turn in range(1, 5):
            said = [rng.choice(["the", "tool", "plan", "a", "now.", "Builds", "-"]) for _ in range(rng.randint(1, 60))]
            rows.append((conv, turn, " ".join(last.split()[: rng.randint(0, 8)] + said + said[-9:])))
            last = rows[-1][2]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{path}/conversations.parquet")


def match(a, b, n):
    """Matches and mismatches of the runs ``a`` and ``b`` of at most ``n`` words, and whether that is acceptable."""
    same, wrong, content, at = 0, 0, False, 0
    while at < min(len(a), len(b), n):
        if a[at] == b[at]:
            same, content = same + 1, content or (a[at] not in ("", "the", "a", "so"))
        elif wrong == 5 or at + 1 >= min(len(a), len(b), n) or a[at + 1] != b[at + 1]:
            break
        else:
            wrong += 1
        at += 1
    return same, wrong, same >= 3 and (same >= 5 or content)


def turns(spark, path):
    out = {}
    for r in sorted(catalogue.talk(spark, path).collect(), key=lambda r: (r.project, r.i)):
        out.setdefault((r.project, r.source), []).append((r.i, r.norm))
    return out


def test_openings_meet_the_turn_before_without_a_broadcast_of_words(spark, tmp_path):
    conversations(spark, tmp_path)
    found = catalogue.cross_source_repeat(spark, str(tmp_path))
    assert "Broadcast" not in plan(found)  # a small file's words need not be small
    want, said = {}, turns(spark, str(tmp_path))
    for (project, source), own in said.items():
        later = [s for p, s in said if p == project and s > source]
        if later:
            nxt = said[project, min(later)]
            run, i = [x for _, x in nxt[:20]], nxt[0][0]
            tail = [(j, [x for _, x in own[k : k + 20]]) for k, (j, _) in enumerate(own) if own[-1][0] * 400 + 300 - j * 400 <= 90_000]
            want[project, source, min(later), i] = (len(tail), max((j for j, own_run in tail if match(own_run, run, i - j)[2]), default=None))
    assert {(r.project, r.source, r.next_source, r.i): (r.n_tail, r.nearest) for r in found.collect()} == want
    assert any(x[1] is not None for x in want.values()) and any(x[1] is None for x in want.values())


def test_candidates_shuffle_words_once_and_no_runs(spark, tmp_path):
    conversations(spark, tmp_path)
    found = repeats.candidates(catalogue.talk(spark, str(tmp_path)))
    assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    want = {}
    for (project, source), own in turns(spark, str(tmp_path)).items():
        norms = [x for _, x in own]
        for b in range(len(own)):
            for a in range(b):
                same, wrong, fits = match(norms[a : a + 20], norms[b : b + 20], b - a)
                if (b - a) * 400 <= 90_000 and fits:
                    want[project, source, own[b][0]] = (own[a][0], same, wrong)
    assert {(r.project, r.source, r.i): (r.j, r.matches, r.mismatches) for r in found.collect()} == want
    assert len(want) > 20


def test_fuzzy_keys_meet_for_pairs_only_and_long_words_too(spark):
    rng = random.Random(11)
    parts = ["th", "of", "an", "er", "tion", "es"]  # few syllables: short pieces are shared by most words
    words = {"".join(rng.choices(parts, k=rng.randint(3, 5))) for _ in range(250)}
    for length in (16, 20, 24, 40):
        own = "".join(rng.choices("abcde", k=length))
        words |= {own, own[1:], own[:5] + "x" + own[6:], own[:-3], own + "yz", "q" + own[2:]}
    words = sorted(words)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        return row[-1]

    want = {(a, b): round(200 * common(a, b) / (len(a) + len(b)), 6) for n, a in enumerate(words) for b in words[n + 1 :]}
    want = {pair: ratio for pair, ratio in want.items() if ratio >= 85}
    got = catalogue.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "norm string"))
    assert "Broadcast" not in plan(got)
    assert {(r.a, r.b): r.ratio for r in got.collect()} == want and any(len(a) > 20 for a, _ in want)
    lengths = sorted({len(w) for w in words if len(w) <= 13})
    sides = [{(key, w) for w in words if len(w) <= 13 for key, _ in catalogue._fuzzy_words(w, side, lengths)} for side in (0, 1)]
    by_key = {}
    for key, w in sides[1]:
        by_key.setdefault(key, set()).add(w)
    met = {tuple(sorted((w, x))) for key, w in sides[0] for x in by_key.get(key, ()) if x != w}
    assert met == {pair for pair in want if max(map(len, pair)) <= 13}


def test_backgrounds_equal_the_sql_to_the_last_bit(spark):
    rng = random.Random(4)
    rows = [(source, k, rng.choice([None, round(rng.random() * 200, 2) / 3]) if source % 5 == 0 else round(rng.random() * 200, 2) / 3) for source in range(60) for k in range(rng.randint(1, 90))]
    rows += [(99, k, None) for k in range(3)]
    got = {r.source: r.background for r in signal.background(spark.createDataFrame(rows, "source long, k long, level double")).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE f (source BIGINT, level DOUBLE)")
    db.executemany("INSERT INTO f VALUES (?, ?)", [(source, level) for source, _, level in rows])
    assert got == dict(db.execute("SELECT source, quantile_cont(level, 0.1) FROM f GROUP BY source").fetchall())


def test_takes_that_tie_in_score_and_first_word_go_to_the_later_last_word(spark):
    rows = [(1, 0, 5, end, 90.0) for end in (7, 12, 9)] + [(1, 1, 5, end, 90.0) for end in (12, 7)]
    for given in (rows, rows[::-1]):
        t = spark.createDataFrame(given, "project long, sentence long, first_word long, last_word long, score double").coalesce(1)
        for prefer in ("best", "last"):
            assert sorted((r.sentence, r.last_word) for r in takes.chosen(t, prefer).collect()) == [(0, 12), (1, 12)]


def documents(spark, path, seed=6):
    rng = random.Random(seed)
    said = ["the", "of", "um", "er", "plan", "goes", "on.", "well,", "-", "Tool?"]
    rows = [(k, " ".join(rng.choices(said, k=rng.randint(0, 90))) + rng.choice(["", " ", "\n"])) for k in range(30)] + [(90, None), (91, " \n "), (92, "um")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("module, name", [(catalogue, n) for n in ("merge_touching", "remove_tiny", "marker_frame", "filler_spans")] + [(assembly, n) for n in ("kept_ranges", "chapter_first", "unscripted_marker", "midpoint_label", "eval_rates", "subword_times")] + [(rules, n) for n in ("judge_context", "zone_split")])
def test_word_queries_shuffle_texts_only_and_equal_their_sql(spark, tmp_path, module, name):
    documents(spark, tmp_path)
    found = getattr(module, name)(spark, str(tmp_path))
    own = plan(found)
    exchanges = [line for line in own.splitlines() if "Exchange" in line and "ReusedExchange" not in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges) and "Join" not in own, own
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in found.columns)
    want = db.execute(f"SELECT {columns} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and want


def test_blocks_of_the_vocabulary_are_dealt_in_parts(spark, tmp_path):
    rng = random.Random(2)
    said = " ".join("ofth" + "".join(rng.choices("abcd", k=rng.randint(4, 9))) for _ in range(120))
    spark.createDataFrame([(1, 1, said)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalogue.fuzzy_vocab(spark, str(tmp_path))
    assert "part" in plan(found).split("ShuffledHashJoin", 1)[1].splitlines()[0]
    v = sorted({w for w in said.split() if 9 <= len(w) <= 12})
    got = [(r.a, r.b) for r in found.collect()]
    assert sorted(got) == [(a, b) for n, a in enumerate(v) for b in v[n + 1 :] if abs(len(a) - len(b)) <= 2]
