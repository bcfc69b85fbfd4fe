import corpus_pipeline
from wordloom.llm import decontaminate

from test_resemblance import _components, _exact, _fp


def test_stages_keep_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    items.choose({})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, sf_dir).cache()
        assert new.columns == docs.columns
        left = {r.doc_id for r in new.collect()}
        before = {r.doc_id for r in now.collect()}
        if name == "language ID":
            assert before == left
        elif name == "SimHash near-dedup":
            fps = {i: _fp(texts[i]) for i in before}
            linked = [(i, j) for i in before for j in before if j < i and ((fps[i] ^ fps[j]).bit_count() <= 2 or _exact(texts[i], texts[j]) >= 0.8)]
            assert left == set(_components(before, linked).values())
        elif name == "benchmark decontamination":
            assert before - left == {i for i in before if items.search(texts[i])}
        else:
            assert before == left and new.where("text RLIKE 'token = .[0-9a-f]{32}'").count() == 0
        now = new
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_only_rows_of_equal_id_and_text_are_one(spark):
    rows = [(1, "first words of one"), (1, "other words than those before"), (1, "first words of one"), (None, "no id here"), (None, "nor is one at this place"), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted(set(rows), key=str)
