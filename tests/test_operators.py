import math
from collections import Counter as Bag

import numpy as np
import pytest
from pyspark.sql import functions as F

from values import values
from streamloom import functions as fn
from streamloom import operators as op
from streamloom import sources as src
from streamloom.monitor import Observed, Timer, estimated_size
from streamloom.plans import Graph, only, run
from streamloom.plans.ordered import ranks, running


def line(spark, *nodes, inputs=None):
    return only(run(spark, Graph().pipeline(*nodes), inputs))


def numbers(spark, n=1000):
    producer = src.Multiples(n)
    return lambda *nodes: line(spark, producer, *nodes, inputs={producer: 1})


def test_aggregates_of_0_to_999(spark):
    of = numbers(spark)
    assert of(op.Sum("_0")).first()[0] == 499500
    assert tuple(of(op.Average("_0")).first()) == (499.5, 1000, 499500)
    assert of(op.Count()).first()[0] == 1000
    assert (of(op.Min("_0")).first()[0], of(op.Max("_0")).first()[0]) == (0, 999)
    sd, n, s, sq = of(op.StdDev("_0")).first()
    assert (round(sd, 9), n, s, sq) == (round(288.8194360957494, 9), 1000, 499500, sum(i * i for i in range(1000)))


def test_aggregates_of_nothing_one_row_and_negatives(spark):
    empty = spark.createDataFrame([], "x bigint")
    of = lambda df, node: line(spark, src.Table(df), node).first()
    assert of(empty, op.Sum("x"))[0] == 0 and of(empty, op.Count())[0] == 0
    assert of(empty, op.Min("x"))[0] is None and of(empty, op.Max("x"))[0] is None and of(empty, op.Max("x", floor_zero=True))[0] == 0
    assert tuple(of(empty, op.Average("x"))) == (None, 0, 0) and tuple(of(empty, op.StdDev("x"))) == (None, 0, 0, 0)
    one = spark.createDataFrame([(-4,)], "x bigint")
    assert tuple(of(one, op.StdDev("x"))) == (None, 1, -4, 16)
    assert of(one, op.Max("x"))[0] == -4 and of(one, op.Max("x", floor_zero=True))[0] == 0


def test_aggregation_is_partial_then_final(spark):
    plan = numbers(spark)(op.Sum("_0"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("HashAggregate") == 2


def test_user_defined_and_two_phase_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "k string, x double")
    assert dict(map(tuple, line(spark, src.Table(df), op.PythonAggregate(lambda v: float(v.prod()), "x", "double", keys=["k"])).collect())) == {"a": 4.0, "b": 2.0}
    assert tuple(line(spark, src.Table(df), op.TwoPhase({"s": "sum(x)"}, {"s": "sum(s)"})).first()) == (7.0,)


def test_running_values(spark):
    df = spark.createDataFrame([(i, i % 3, i * 2) for i in range(500)], "i bigint, k bigint, x bigint").repartition(7)
    total = {r["i"]: r["t"] for r in line(spark, src.Table(df), op.Running({"t": F.col("x")}, ["i"])).collect()}
    assert total == {i: i * (i + 1) for i in range(500)}
    count = {r["i"]: r["n"] for r in line(spark, src.Table(df), op.RunningCount("k", ["i"])).collect()}
    assert count == {i: i // 3 + 1 for i in range(500)}
    ties = spark.createDataFrame([(0, i) for i in range(50)], "t bigint, i bigint")
    assert sorted((r["i"], r["n"]) for r in ranks(ties, [], ["t", "i"], "n").collect()) == [(i, i + 1) for i in range(50)]
    assert running(ties.limit(0), ["t"], ["i"], {"s": F.lit(1)}).count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, i bigint")
    assert sorted((str(r["k"]), r["i"], r["n"]) for r in ranks(nulls, ["k"], ["i"], "n").collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


def test_groupings(spark):
    keyed = spark.createDataFrame([(k, str(i)) for i in range(200) for k in ("a", None, "b")], "k string, payload string")
    dealt = line(spark, src.Table(keyed), op.Select("k", "spark_partition_id() as p", instances=5).group("input", [0]))
    assert dealt.distinct().count() == 3
    structs = spark.createDataFrame([((1, "x"), [1, 2]), ((1, "x"), [1, 2]), ((2, None), [])], "k struct<a:int,b:string>, l array<int>")
    for column in ("k", "l"):
        dealt = line(spark, src.Table(structs), op.Select(f"{column} as k", "spark_partition_id() as p", instances=3).group("input", [column]))
        assert dealt.distinct().count() == 2
    assert line(spark, src.IntRange(0, 50), op.Select("spark_partition_id() as p").group("input", "global")).distinct().count() == 1
    copies = line(spark, src.IntRange(0, 4), op.Identity(instances=5).group("input", "all"))
    assert Bag(values(copies)) == Bag({i: 5 for i in range(4)}) and sorted(set(values(copies, "_instance"))) == [0, 1, 2, 3, 4]
    even = line(spark, src.IntRange(0, 1000), op.Select("spark_partition_id() as p", instances=5).group("input", "shuffle")).groupBy("p").count()
    assert sorted(values(even, "count")) == [200] * 5
    with pytest.raises(ValueError):
        op.Identity().group("input", "somewhere")


def test_sources(spark, tmp_path):
    counter = src.Counter(2)
    g = Graph()
    g.add(counter)
    assert [sorted(values(df)) for df in run(spark, g, {counter: 3}).values()] == [[1, 2, 3]] * 2
    assert sorted(values(line(spark, src.IntRange(5, 234), op.Identity()))) == list(range(5, 234))
    burst = src.Burst(3)
    assert sorted(values(line(spark, burst, op.Identity(), inputs={burst: 2}))) == [0, 0, 1, 1, 2, 2]
    numbers_ = src.Multiples(4)
    assert sorted(values(line(spark, numbers_, op.Identity(), inputs={numbers_: 2}), "_0")) == sorted([0, 1, 2, 3, 0, 2, 4, 6])
    words = src.RandomWords(seed=1)
    draw = lambda: sorted(map(tuple, line(spark, words, op.Identity(), inputs={words: 50}).collect()))
    assert draw() == draw() and len(draw()) == 50
    (tmp_path / "t.txt").write_text("  a b \n\nc\t\n")
    assert values(line(spark, src.TextLines(str(tmp_path / "t.txt")), op.Identity()), "line") == ["a b", "", "c"]
    (tmp_path / "t.csv").write_text("1,x\n2,y\n")
    assert line(spark, src.Files(str(tmp_path / "t.csv"), "csv", "a int, b string"), op.Identity()).count() == 2
    made = src.python_source(lambda part: [(part, i) for i in range(part)], "part int, i int", 3)
    assert line(spark, made, op.Identity()).count() == 3
    (tmp_path / "s.bin").write_bytes(bytes([1, 2, 3]))
    trace = line(spark, src.Traces(str(tmp_path / "s.bin"), lambda b: (list(b), 10)), op.Identity())
    assert values(trace, "x") == [1.0, 2.0, 3.0]


def test_word_count(spark):
    rows = spark.createDataFrame([("a b  a",), ("b",), ("",)], "line string")
    assert dict(map(tuple, line(spark, src.Table(rows), op.Tokenise(), op.KeyedSum()).collect())) == {"a": 2, "b": 2, "": 2}


def test_sinks(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    for sink in (src.Discard(), src.Show(), src.LogLines(), src.PerKeyFiles(str(tmp_path / "out"), "k"), src.Write(str(tmp_path / "j"), "json")):
        with run(spark, Graph().pipeline(src.Table(rows), sink)) as found:
            assert not found
            done = found.execute()
            if isinstance(sink, src.LogLines):
                assert sorted(done[sink.id]) == ["a: 1", "b: 2"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["k=a", "k=b"]
    assert len(list(run(spark, Graph().pipeline(src.Table(rows), op.Identity())).stream())) == 2


def test_sieve(spark):
    stage, g = op.Sieve(1000), Graph()
    g.connect(src.IntRange(2, 1000), "output", stage, "input")
    prime, rest = run(spark, g).of(stage, "prime"), run(spark, g).of(stage, "output")
    assert prime.count() == 168 and rest.count() == 998 - 168


def test_python_node_lifecycle(spark):
    class Body:
        def __init__(self, k):
            self.n, self.k = 0, k

        def process(self, row):
            self.n += 1
            return [("half", row["value"] * self.k)] if row["value"] % 2 == 0 else None

        def finish(self):
            return [("count", (self.n,))]

    node, after, g = op.PythonNode(Body, {"half": "value bigint", "count": "value bigint"}, params={"k": 10}, order=["value"]), op.Apply(fn.add), Graph()
    g.connect(src.IntRange(0, 5), "output", node, "input").connect(node, "count", after, "input")
    with run(spark, g) as found:
        assert sorted(values(found.of(node, "half"))) == [0, 20, 40] and values(found.of(after)) == [6]


def test_python_node_with_dealt_rows(spark):
    from datetime import datetime

    class Share:
        def __init__(self):
            self.n = 0

        def process(self, row):
            self.n += 1
            yield "each", (row["value"], row["at"], row[2])

        def finish(self):
            return [("count", (self.n,))]

    at = datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(i, at, None if i % 2 else "x") for i in range(900)], "value bigint, at timestamp_ntz, `odd name` string").coalesce(1)
    for instances, objects in ((3, 3), (None, int(spark.conf.get("spark.sql.shuffle.partitions")))):
        node = op.PythonNode(Share, {"each": "value bigint, at timestamp_ntz, s string", "count": "n bigint"}, instances=instances).group("input", "shuffle")
        g = Graph().connect(src.Table(df), "output", node, "input")
        with run(spark, g) as found:
            assert sorted(map(tuple, found.of(node, "each").collect())) == [(i, at, None if i % 2 else "x") for i in range(900)]
            counts = values(found.of(node, "count"), "n")
        assert len(counts) == objects and sum(counts) == 900 and max(counts) - min(counts) <= objects
        with run(spark, Graph().connect(src.Table(df.where("value < 0")), "output", node, "input")) as found:
            assert values(found.of(node, "each")) == [] and sum(values(found.of(node, "count"), "n")) == 0


def test_random_ports_are_drawn_by_many_tasks(spark, tmp_path):
    from streamloom import catalog

    spark.range(1000).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.random_ports_agree(spark, str(tmp_path))
    body = df._jdf.queryExecution().toString().split("InMemoryRelation")[1]
    assert "RoundRobinPartitioning" in body and "SinglePartition" not in body.split("InMemoryTableScan")[0]
    assert tuple(df.first()) == (1000, True)


def test_apply_field(spark):
    df = spark.sql("select 1L as count, named_struct('x', 2.0D, 'rf', 10.0D) as unit")
    node = op.ApplyField(lambda x, k, rf: x * k + rf, "unit.x", {"k": 3}, given={"rf": "unit.rf"})
    row = line(spark, src.Table(df), node).first()
    assert row["count"] == 1 and tuple(row["unit"]) == (16.0, 10.0)


def test_functions(spark):
    df = spark.createDataFrame([(-7,), (6,)], "value bigint")
    got = [tuple(r) for r in df.select(fn.floor_mod(F.col("value"), 3), fn.floor_divide(F.col("value"), 2), fn.not_divisible(F.col("value"), 3), fn.divide(F.col("value"), 0)).collect()]
    assert got == [(2, -4, True, None), (0, 3, False, None)]


# --- signals -------------------------------------------------------------------------------------------


def traces(spark, *signals):
    return src.Table(spark.createDataFrame([(f"t{k}", i, float(x)) for k, s in enumerate(signals) for i, x in enumerate(s)], "trace_id string, n bigint, x double").repartition(3))


def samples(df, k=0):
    return [r["x"] for r in sorted(df.where(f"trace_id = 't{k}'").collect(), key=lambda r: r["n"])]


@pytest.mark.parametrize("signal", [[5.0] * 9, list(range(1, 12)), [1.0, -1.0] * 8, [3.0, 1.0], [2.0]])
def test_mean_norm(spark, signal):
    k = 3
    want = [x / (sum(abs(y) for y in signal[max(0, i - k) : i + k]) / (2 * k + 1)) for i, x in enumerate(signal)]
    assert samples(line(spark, traces(spark, signal, [9.0]), op.MeanNorm(k))) == pytest.approx(want)


def test_long_traces_are_cut_without_seams(spark, monkeypatch):
    from streamloom.operators import signal as module

    monkeypatch.setattr(module, "CHUNK", 8)
    x = np.random.default_rng(0).normal(size=100)
    k = 5
    want = [v / (np.abs(x[max(0, i - k) : i + k]).sum() / (2 * k + 1)) for i, v in enumerate(x)]
    assert samples(line(spark, traces(spark, x), op.MeanNorm(k))) == pytest.approx(want)


def test_gain_norm(spark):
    x = np.random.default_rng(1).normal(size=60)
    h = 1 - np.abs(np.arange(-4, 5)) / 5.0
    rms = np.sqrt(np.convolve(x**2, h, "same"))
    assert samples(line(spark, traces(spark, x), op.GainNorm(2.0, 0.5))) == pytest.approx(list(x * rms / (rms**2 + 1e-12 * rms.max())))


def test_trends(spark):
    ramp = [3.0 + 2 * i for i in range(10)]
    assert samples(line(spark, traces(spark, ramp), op.DetrendLinear())) == pytest.approx([0.0] * 10, abs=1e-9)
    assert samples(line(spark, traces(spark, ramp, [7.0]), op.DetrendSimple())) == pytest.approx([0.0] * 10)
    assert samples(line(spark, traces(spark, ramp, [7.0]), op.DetrendSimple()), 1) == [0.0]
    assert samples(line(spark, traces(spark, ramp), op.Demean())) == pytest.approx([x - 12 for x in ramp])
    assert samples(line(spark, traces(spark, [-3.0, 0.0, 2.0]), op.OneBit())) == [-1.0, 0.0, 1.0]
    assert samples(line(spark, traces(spark, ramp), op.Decimate(4))) == [3.0, 11.0, 19.0]


def test_whitening_and_bandpass(spark):
    x = np.random.default_rng(2).normal(size=64)
    white = samples(line(spark, traces(spark, x), op.Whiten()))
    assert np.abs(np.fft.fft(white)) == pytest.approx(np.ones(64))
    t = np.arange(1000) / 100.0
    slow, fast = np.sin(2 * math.pi * 2 * t), np.sin(2 * math.pi * 30 * t)
    kept = samples(line(spark, traces(spark, slow + fast), op.Bandpass(0.5, 8.0, 100.0)))
    assert np.abs(np.array(kept) - slow)[100:-100].max() < 0.05


def test_numbered(spark):
    df = spark.createDataFrame([("a", 30), ("a", 10), ("b", 20), ("a", 20)], "trace_id string, ts bigint")
    assert sorted((r["trace_id"], r["ts"], r["n"]) for r in line(spark, src.Table(df), op.Numbered(["ts"])).collect()) == [("a", 10, 0), ("a", 20, 1), ("a", 30, 2), ("b", 20, 0)]


def test_monitoring(spark):
    seen = Observed()
    df = line(spark, src.IntRange(0, 7), seen)
    with Timer() as timer:
        df.collect()
    assert seen.counts["rows"] == 7 and timer.seconds > 0 and estimated_size(df) > 0


def test_building_a_running_sum_starts_no_job(spark):
    spark.sparkContext.setJobGroup("building", "")
    df = line(spark, src.IntRange(0, 100), op.Running({"total": F.col("value")}, ["value"]))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    assert df.agg(F.max("total")).first()[0] == 4950 and spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
