import time
from collections import Counter as Bag

import pytest

from streamloom import operators as op
from streamloom.plans import Graph
from streamloom.streaming import BoundedStream, DailyWindow, StreamCount, StreamRunningCount, StreamRunningSum, run_stream, to_completion

SCHEMA = "i bigint, k string, x double"


@pytest.fixture
def folder(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(part * 10 + j, "ab"[j % 2], float(j)) for j in range(10)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
        for f in (tmp_path / f"in{part}").glob("part-*.parquet"):
            f.rename(tmp_path / f"p{part}.parquet")
    return str(tmp_path)


def source(folder, **kw):
    return BoundedStream(folder, "p*.parquet", SCHEMA, **kw)


def test_state_lasts_across_batches(spark, folder):
    got = to_completion(spark, Graph().pipeline(source(folder, files_per_trigger=1), StreamRunningCount("k", ["i"])))
    assert Bag((r["k"], r["n"]) for r in got.collect()) == Bag((k, n) for k in "ab" for n in range(1, 16))
    total = to_completion(spark, Graph().pipeline(source(folder, files_per_trigger=1), StreamRunningSum("k", "x", ["i"])))
    assert max(r["total"] for r in total.collect() if r["k"] == "b") == 3 * (1 + 3 + 5 + 7 + 9)


def test_stream_equals_batch(spark, folder):
    got = to_completion(spark, Graph().pipeline(source(folder), op.Where("x > 2"), StreamCount("k")), mode="complete")
    assert dict(map(tuple, got.collect())) == {"a": 9, "b": 12}


def test_several_sinks_from_one_batch(spark, folder):
    seen = []
    done = run_stream(spark, Graph().pipeline(source(folder), op.Identity()), sink=lambda df, k: seen.extend([df.count(), df.filter("k = 'a'").count()]))
    assert done.wait(60) and seen == [30, 15]


def test_event_time_windows_with_late_data(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' as ts, 'a' as k, 1.5D as x union all select timestamp_ntz'2024-01-02 00:00:00', 'a', 2D")
    assert sorted((str(r["day"])[:10], r["n"], r["total"]) for r in DailyWindow("ts", "k", "x").apply(df).collect()) == [("2024-01-01", 1, 1.5), ("2024-01-02", 1, 2.0)]


def test_progress_is_observed_and_settings_stay(spark, folder):
    from streamloom.monitor import StreamProgress

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    seen = StreamProgress()
    spark.streams.addListener(seen)
    try:
        assert to_completion(spark, Graph().pipeline(source(folder), StreamRunningCount("k", ["i"]))).count() == 30
        deadline = time.time() + 20
        while not seen.ended and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sum(rows for batches in seen.batches.values() for _, rows, _ in batches) > 0 and set(seen.ended.values()) == {None}
    assert spark.conf.get(provider, None) == before


def test_a_table_in_a_folder_of_files_streams_whole(spark, tmp_path):
    from streamloom import catalog

    one, many = tmp_path / "one", tmp_path / "many"
    lines = [(i, f" a b{i % 3}\nc ") for i in range(40)]
    spark.createDataFrame(lines, "doc_id bigint, text string").repartition(4).write.parquet(f"{many}/documents.parquet")
    spark.createDataFrame(lines, "doc_id bigint, text string").coalesce(1).write.parquet(f"{one}/in")
    next((one / "in").glob("part-*.parquet")).rename(one / "documents.parquet")
    spark.createDataFrame(lines[:1], "doc_id bigint, text string").write.parquet(f"{many}/other.parquet")
    for d in (one, many):
        want = dict(map(tuple, catalog.wordcount_by_group(spark, str(d)).collect()))
        assert want == {"a": 40, "b0": 14, "b1": 13, "b2": 13, "c": 40}
        assert dict(map(tuple, catalog.stream_wordcount(spark, str(d)).collect())) == want


def test_counts_keep_their_state_on_disk(spark, folder):
    done = run_stream(spark, Graph().pipeline(source(folder), StreamCount("k")), mode="complete", sink=lambda df, k: df.count())
    assert done.wait(60)
    ((_, query),) = done.queries.items()
    assert any("rocksdb" in name for p in query.recentProgress for state in p["stateOperators"] for name in state["customMetrics"])
