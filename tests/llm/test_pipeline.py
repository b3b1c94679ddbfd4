"""The pipeline's stages on awkward rows and the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.fixtures import awkward, empty  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_are_whole():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "token_ids"]


def test_awkward_rows_go_through(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        if name != "token_ids":
            assert out.columns == docs.columns, name
        if name == "language":
            left = {r.doc_id for r in out.collect()}
            assert left & {4, 5, 6, 11} == set() and {1, 2, 3, 9, 10} <= left
        if name == "personal_data":
            assert not [r for r in out.collect() if "ann@shop" in (r.text or "")]
        docs = out
    assert docs.count() > 0


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = corpus_pipeline.language(spark, docs, SF)
    assert judged.count() >= docs.filter(r"text rlike '[a-zA-Z]'").count() - 1
    kept = corpus_pipeline.near_duplicates(spark, judged, SF)
    assert kept.select("doc_id").distinct().count() == kept.count() < judged.count()
    same = corpus_pipeline.personal_data(spark, kept, SF)
    changed = same.alias("x").join(kept.alias("y"), "doc_id").filter("x.text <> y.text")
    assert changed.filter("not y.text rlike '[0-9@]'").count() == 0 and same.count() == kept.count()
