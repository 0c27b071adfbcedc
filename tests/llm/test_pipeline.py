import hashlib

import corpus_pipeline
from frametally.llm import decontaminate, shared


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = shared.table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = shared.stored(stage(spark, docs, sf), "test")
        seen[name] = (before.count(), docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "benchmark decontamination":
            assert decontaminate.contamination(docs, shared.table(spark, sf, "benchmark")).where("contaminated").count() == 0
        if name == "suffix-array repeats":
            lines = [r.text.encode() for r in docs.select("text").collect()]
            assert sum(map(len, lines)) < sum(len(r.text.encode()) for r in before.select("text").collect())
    assert seen["simhash near-duplicates"][0] > seen["simhash near-duplicates"][1] > 0
    assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_pipeline_on_hard_rows(spark, tmp_path, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id", "en", "a", 5), (3, "x y", "en", "b", 3), (3, "x y", "en", "b", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (True, 0)]


def test_reruns_agree(spark, sf):
    def digest():
        rows = sorted(map(repr, corpus_pipeline.run(spark, sf).collect()))
        return hashlib.sha256("".join(rows).encode()).hexdigest()

    assert digest() == digest()
