
from pyspark.sql import functions as F

import corpus_pipeline
from loomlog.llm import queries
from tests.conftest import SF
from tests.llm.test_dedup import cut, linked
from tests.llm.test_text import hits


def write(spark, folder, rows, labels, benchmark):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, score double").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")


def stages(spark, sf_dir):
    """The documents after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = corpus_pipeline.c.scratch(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_follow_plain_versions(spark):
    sf = f"file://{SF}"
    docs, good, single, cut_, clean, last = stages(spark, sf)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    scores = {r.doc_id: r.score for r in queries.op3_quality(spark, sf).collect()}
    kept = texts(good)
    assert set(kept) == {i for i, s in scores.items() if s >= corpus_pipeline.ACCEPT}
    want = {i for i, _, component in linked(list(kept.items())) if i == component}
    assert set(texts(single)) == want
    rows = list(texts(single).items())
    removed = {i: n for i, _, n, _ in cut(rows)}
    after = texts(cut_)
    assert all((removed[i] == 0) == (after[i] == t) for i, t in rows)
    assert {r.doc_id: r.n_chars for r in cut_.collect()} == {i: len(t) for i, t in after.items()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts(clean)) == {i for i, t in after.items() if hits(t, items)[1] == 0}
    assert {r.doc_id for r in last.collect()} == set(texts(clean))
    for df in (good, single, cut_, clean):
        assert df.columns == docs.columns


def test_run_equals_the_stages(spark):
    sf = f"file://{SF}"
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).drop("ids").collect()) == sorted(tuple(r) for r in stages(spark, sf)[-1].drop("ids").collect())


def test_odd_and_empty_documents(spark, tmp_path, docs_rows):
    rows = [(*r, "row", 1.0) for r in [*docs_rows[:40], *docs_rows[:4], (None, docs_rows[2][1], None, None, None), (None, None, None, None, None), (None, "", "en", "s", 0)]]
    write(spark, tmp_path / "odd", rows, [(1, 1, 0), (2, 1, 0)], [(1, "nothing of this kind"), (None, None)])
    out = stages(spark, f"file://{tmp_path}/odd")
    assert out[1].columns == out[0].columns and "row" in out[4].columns
    ids = [r.doc_id for r in out[2].collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    assert out[2].where("doc_id IS NULL").count() == 3
    write(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").isEmpty()


def test_a_text_outlives_blank_rows_of_its_id(spark):
    rows = [(i, t, "en") for i in range(40) for t in (None, " \n", f"text {i} b", f"text {i} a", "")] + [(99, None, "en"), (None, "", "en")]
    for seed in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").orderBy(F.rand(seed)).repartition(5)
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([*((i, f"text {i} a") for i in range(40)), (99, None), (None, "")], key=repr)
