"""The stages one after another, each against its own promise."""

import os
from collections import Counter

import pytest
from helpers import awkward, components, shingle_set

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    from streamloom.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == columns
        rows = docs.collect()
        texts = Counter(r["text"] for r in rows)
        if name == "exact dedup":
            assert max(texts.values()) == 1 and set(texts) == {r["text"] for r in before}
        if name == "n-gram Jaccard join":
            ids = [r["doc_id"] for r in before]
            comps = components(ids, [shingle_set(r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in rows) == sorted(set(comps))
        if name == "mixing":
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before}
        before = rows
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in before)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:2] == ["doc_id", "piece"] and got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
