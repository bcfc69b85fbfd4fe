"""Null ids, clashing columns, ties, repeated rows, empty tables and long texts, for every operator and stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import capfilter, ctw, decontaminate, language, licenses, maintext, packing, repeats, secrets, simhash
from wordloom.llm.common import components

CLASH = ["id", "fp", "key", "row", "words", "start", "spans", "score", "length", "label", "mark", "size", "low", "h", "n", "bucket", "at", "candidates", "base"]
WORDS = "the report of this season was long and the result of it is known to all who read on".split()
TEXTS = [
    "the report of the season was long and known to all. Licensed under the MIT License.",
    "the report of the season was long and known to all. Licensed under the MIT License.",
    "token = " + "0a1b2c3d" * 5 + " and the rest of the report",
    None, "", "   \n\t", "½ 12", "é\U0001f600 word",
    " ".join(random.Random(1).choices(WORDS, k=40_000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, "another text without an id"), (0, TEXTS[0]), (1, "a second text of document one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH]).repartition(2).cache()


def _ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=str)


def _tagger():
    return language.Tagger.train([("en", " ".join(WORDS * 9)), ("de", "der bericht dieser zeit war lang und das ergebnis ist allen bekannt " * 9)], rounds=3)


def test_every_row_has_a_result(spark, odd):
    want = _ids(odd)
    known = spark.createDataFrame([(1, "nothing like it at all in here")], "item_id long, text string")
    assert _ids(secrets.scan(odd).select("row.doc_id")) == want
    assert _ids(licenses.scan(odd)) == want
    assert _ids(language.predict(odd, _tagger())) == want
    assert _ids(simhash.near_duplicates(odd), "id") == want
    assert _ids(repeats.dedup(odd)) == want
    assert _ids(ctw.score(odd, ctw.learn(odd.limit(3)))) == want
    assert decontaminate.find(odd, known).count() == 0 and _ids(decontaminate.clean(odd, known)) == want
    packed = packing.pack(packing.pieces(odd))
    assert packed.where("piece = 0").count() == len(want)
    masked = secrets.masked(odd)
    assert masked.columns == odd.columns and _ids(masked) == want and masked.where("text LIKE '%0a1b2c3d0a%'").count() == 0
    left = language.accepted(odd, _tagger())
    assert left.columns == odd.columns and left.where("text IS NULL OR trim(text) = ''").count() == 0


def test_equal_rows_have_equal_results(spark, odd):
    rows = odd.where(F.col("text") == TEXTS[0])
    for made in (licenses.scan(rows), language.predict(rows, _tagger()), secrets.scan(rows).select(secrets.digest(F.col("spans")).alias("s"))):
        assert made.drop("doc_id").distinct().count() == 1


def test_vectors_with_null_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in ("id", "filter", "node", "many", "h0", "rep")])
    got = sorted((tuple(r) for r in capfilter.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 1, 1, False), (2, 1, 2, True), (2, 1, 2, True), (None, 0, None, True)], key=str)


def test_pages_of_every_kind(spark):
    deep = "<div>" * 3000 + "<p>Text that is deep inside, with enough words to be kept as a sentence.</p>" + "</div>" * 3000
    long_ = "<article><p>" + "One sentence of many words that belongs to the story. " * 20_000 + "</p></article>"
    rows = [(1, "u", None, "x"), (None, "u", "", "x"), (2, None, deep, "x"), (3, "u", long_, "x"), (3, "u", long_, "x"), (4, "u", "<p", "x")]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and [r.n_chars for r in got if r.page_id == 3] == [20_000 * 54 - 1] * 2
    assert all(r.n_chars == len(r.text) for r in got) and next(r for r in got if r.page_id == 2).text.startswith("Text that is deep")


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    items = spark.createDataFrame([(1, "some item text here")], "item_id long, text string")
    assert secrets.masked(none).count() == language.accepted(none, _tagger()).count() == decontaminate.clean(none, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count()
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0 and packing.pack(packing.pieces(none)).count() == 0
    assert language.predict(odd, language.train(none)).where("lang_pred <> 'und'").count() == 0


def test_the_pipeline_on_an_empty_folder(spark, tmp_path):
    for name, shape in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_matches_brute_force(spark):
    """Against the alignment of every item with every stretch of every document."""
    rng = random.Random(12)
    vocab = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate((4, 8, 15, 15, 25, 40))]
    docs = []
    for i in range(40):
        text = rng.choices(vocab, k=rng.randint(0, 60))
        if i % 2:
            copy = items[rng.randrange(6)][1].split()
            for at in rng.sample(range(len(copy)), rng.randint(0, len(copy) // 4)):  # substituted, or left out
                copy[at] = rng.choice([None, f"new{i}"])
            at = rng.randint(0, len(text))
            text[at:at] = [w for w in copy if w]
        docs.append((i, " ".join(text)))
    want = set()
    for doc, text in docs:
        own = decontaminate._hashes(decontaminate.words(text))
        for item, said in items:
            it = decontaminate._hashes(decontaminate.words(said))
            slack = int(0.2 * len(it) + 1e-9) + 1
            for at in range(-slack, len(own)):
                part = own[max(0, at - slack) : at + len(it) + 2 * slack]
                if len(part) and decontaminate.align(it, part)[0] >= 0.8 * len(it) - 1e-9:
                    want.add((doc, item))
                    break
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(want) > 12
    missed = want - got  # copies with more edits than the seeds' bound on item words and passage words together
    assert all(any(d == doc for d, _ in docs) for doc, _ in missed) and len(missed) <= len(want) // 10


@pytest.mark.parametrize("n, least", [(20, 0.0), (24, 0.3), (32, 0.9), (40, 0.95), (64, 0.95)])
def test_power_of_the_randomness_battery(spark, n, least):
    """Share of random base-62 tokens found among ordinary long words, by length; words stay unmarked."""
    rng = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["internationalisation", "counterrevolutionary", "incomprehensibility_", "electroencephalogram", "see_the_other_file_of", "path/to/some/longer/name", "thyroparathyroidectomized"]
    words += ["-" * 26, letters]  # these must not stretch what ordinary text is measured by, nor be found
    rows = [(i, "x " + "".join(rng.choices(letters, k=n)) + " y") for i in range(40)] + [(1000 + i, f"a {rng.choice(words)} b") for i in range(200)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", F.size("spans").alias("n")).where("n > 0").collect()
    hits = {r.doc_id for r in found}
    assert sum(i < 1000 for i in hits) / 40 >= least and sum(i >= 1000 for i in hits) <= 2
