import os

import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, corpus
from streamloom.llm import blocknames, common, jaccard


def test_materialised_tables_are_in_the_shared_folder_and_can_be_released(spark):
    shared = common.shared_dir(spark).removeprefix("file:")
    df = common.materialise(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(os.path.realpath(shared)) or shared in df.inputFiles()[0]
    common.release(spark)
    assert not os.path.exists(common._own_folder(spark).removeprefix("file://").removeprefix("file:"))


def test_temporary_tables_go_and_kept_ones_stay(spark):
    with common.temporary(spark):
        with common.temporary(spark):
            gone, outer = common.materialise(spark.range(3)), common.materialise(spark.range(4), keep=True)
            kept = common.materialise(gone)
        assert outer.count() == 4
        kept = common.materialise(outer, keep=True)
    assert kept.count() == 4 and all(not os.path.exists(f.removeprefix("file://")) for df in (gone, outer) for f in df.inputFiles())


def test_dense_names_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1009 as k", "cast(id as string) as v")
    want = {k: i for i, k in enumerate(sorted(r["k"] for r in rows.collect()))}
    for n in (1, 3, 16):
        named = common.dense_names(rows.repartition(n), ["k"])
        assert {r["k"]: r["name"] for r in named.collect()} == want and named.columns == ["k", "v", "name"]
    assert common.dense_names(rows.limit(0), ["k"]).count() == 0


@pytest.fixture
def changing(spark, monkeypatch):
    """Each written table is followed by another number of cores, as when executors come and go between passes."""
    cores = iter([1, 64, 3, 32, 2, 16] * 100)
    write = common.materialise

    def written(df, keep=False):
        out = write(df, keep)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores))
        return out

    for module in (common, blocknames, jaccard):
        monkeypatch.setattr(module, "materialise", written)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_keep_their_numbers_when_the_cluster_changes(spark, tmp_path, changing):
    spark.createDataFrame(corpus(5, 200), SCHEMA).repartition(40).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    texts = {r["text"] for r in docs.collect()}
    kept = blocknames.drop_duplicates(docs).collect()
    assert len(kept) == len(texts) and {r["text"] for r in kept} == texts
    collided = blocknames.exact_duplicates(docs, block_bytes=16, route="octet_length({})").collect()
    assert len(collided) == 200 and sum(r["kept"] for r in collided) == len(texts)
    found = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert {r["doc_id"] for r in jaccard.keep_representatives(docs).collect()} == {c for _, c in found}
