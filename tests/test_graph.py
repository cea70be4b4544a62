from collections import Counter as Bag

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from values import values
from streamloom import functions as fn
from streamloom import operators as op
from streamloom import sources as src
from streamloom.plans import Composite, Graph, GraphError, Node, Port, composite, only, run
from streamloom.plans.runner import bind_inputs


def test_pipeline_passes_everything(spark):
    counter = src.Counter()
    found = only(run(spark, Graph().pipeline(counter, *[op.Identity() for _ in range(4)]), {counter: 5}))
    assert sorted(values(found)) == [1, 2, 3, 4, 5]


def test_ports_of_a_merge_never_meet(spark):
    counter, merge, g = src.Counter(2), op.ConcatPorts(["input0", "input1"]), Graph()
    a, b = op.Identity(), op.Identity()
    g.connect(counter, "output0", a, "input").connect(counter, "output1", b, "input").connect(a, "output", merge, "input0").connect(b, "output", merge, "input1")
    assert Bag(values(only(run(spark, g, {counter: 1})))) == Bag({"1": 2})


def test_tee_gives_each_branch_everything(spark):
    counter, a, b, g = src.Counter(), op.Identity(), op.Identity(), Graph()
    g.connect(counter, "output", a, "input").connect(counter, "output", b, "input")
    found = run(spark, g, {counter: 5})
    assert [sorted(values(df)) for df in found.values()] == [[1, 2, 3, 4, 5]] * 2


def test_edge_twice_delivers_twice(spark):
    counter, end = src.Counter(), op.Identity()
    g = Graph().connect(counter, "output", end, "input").connect(counter, "output", end, "input")
    assert Bag(values(only(run(spark, g, {counter: 10})))) == Bag({i: 2 for i in range(1, 11)})


def test_two_producers_on_one_port(spark):
    a, b, end = src.Counter(), src.IntRange(5, 8), op.Identity()
    g = Graph().connect(a, "output", end, "input").connect(b, "output", end, "input")
    assert sorted(values(only(run(spark, g, {a: 2})))) == [1, 2, 5, 6, 7]


def test_chain_keeps_falsy_and_drops_null(spark):
    counter = src.Counter()
    chain = op.chain([fn.add, (fn.multiply, {"n": 3}), fn.is_odd])
    assert sorted(values(only(run(spark, Graph().pipeline(counter, chain), {counter: 2})))) == [False, True]
    rows = src.Rows([0, 1, 2])
    assert sorted(values(only(run(spark, Graph().pipeline(rows, op.Apply(lambda c: F.when(c < 2, c))))))) == [0, 1]
    assert sorted(values(only(run(spark, Graph().pipeline(src.Rows([0, 1, 2]), op.PythonApply(lambda v: None if v == 2 else v, "bigint")))))) == [0, 1]


def test_chain_is_one_projection_without_python(spark):
    plan = only(run(spark, Graph().pipeline(src.IntRange(0, 9), op.chain([fn.add] * 5))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Project") <= 2


def _inner(n):
    g, a, b = Graph(), op.Apply(fn.multiply, {"n": n}), op.Apply(fn.add)
    g.connect(a, "output", b, "input")
    return g, {"in": (a, "input")}, {"out": (b, "output")}


def test_nested_composites_and_two_producers_into_one(spark):
    middle = Graph()
    a, b = composite(_inner, 2), composite(_inner, 10)
    middle.connect(a, "out", b, "in")
    both = Composite(middle, {"in": (a, "in")}, {"out": (b, "out")})
    g = Graph().connect(x := src.IntRange(1, 3), "output", both, "in").connect(y := src.IntRange(5, 6), "output", both, "in")
    assert x is not y
    assert sorted(values(only(run(spark, g)))) == [31, 51, 111]
    dot = g.to_dot()
    assert dot.count("subgraph cluster_") == 3 and dot.count("->") == 5


def test_cycles_unknown_ports_and_missing_data_are_errors(spark):
    a, b = op.Identity(), op.Identity()
    g = Graph().connect(a, "output", b, "input").connect(b, "output", a, "input")
    with pytest.raises(GraphError, match="cycle"):
        g.order()
    with pytest.raises(GraphError, match="no output"):
        Graph().connect(a, "nothing", b, "input")
    with pytest.raises(GraphError, match="nothing reaches"):
        run(spark, Graph().pipeline(op.Identity(), op.Identity()))
    with pytest.raises(GraphError, match="not in the graph"):
        bind_inputs(Graph().pipeline(src.Counter()), {"other": 1})


def test_unconnected_parts_and_named_results(spark):
    a, b = src.IntRange(0, 2), src.IntRange(5, 6)
    mid = op.Identity()
    g = Graph().connect(a, "output", mid, "input")
    g.add(b)
    assert {k: sorted(values(v)) for k, v in run(spark, g).items()} == {(mid.id, "output"): [0, 1], (b.id, "output"): [5]}
    assert list(run(spark, g, results={a: ["output"]})) == [(a.id, "output")]


def test_inputs_by_node_name_and_id(spark):
    for key in ("node", "name", "id"):
        counter = src.Counter(name="Producer")
        g = Graph().pipeline(counter, op.Identity())
        found = run(spark, g, {{"node": counter, "name": "Producer", "id": counter.id}[key]: 3})
        assert only(found).count() == 3
    middle = op.Identity()
    g = Graph().pipeline(counter := src.Counter(), middle)
    assert sorted(values(only(run(spark, g, {counter: 1, middle: [7]})))) == [1, 7]


def test_json_inputs(spark, tmp_path):
    g = Graph().pipeline(src.Counter(name="TestProducer"), op.Identity())
    (path := tmp_path / "in.json").write_text('{"TestProducer": 20}')
    assert src.load_inputs(g, file=str(path), text="{}") == {"TestProducer": 20}
    assert src.load_inputs(g, text='{"TestProducer": 3}', iterations=9) == {"TestProducer": 3}
    assert list(src.load_inputs(g, iterations=4).values()) == [4] and list(src.load_inputs(g).values()) == [1]
    with pytest.raises(ValueError):
        src.load_inputs(g, text="{bad")
    with pytest.raises(FileNotFoundError):
        src.load_inputs(g, file="/nowhere")


def test_types_reach_consumers_or_fail():
    schema = StructType().add("number", "long")

    class Maker(Node):
        def __init__(self, schema):
            super().__init__((), (Port("output", schema),))

    end = op.Identity()
    known = Graph().connect(m := Maker(schema), "output", end, "input")
    assert known.propagate_types()[(end.id, "input")] == schema and m.id
    with pytest.raises(GraphError, match="no type"):
        Graph().connect(Maker(None), "output", op.Identity(), "input").propagate_types()


def test_costly_nodes_are_persisted_where_they_branch(spark):
    rows, costly, a, b = src.IntRange(0, 5), op.Delay(0.0), op.Identity(), op.Identity()
    g = Graph().connect(rows, "output", costly, "input").connect(costly, "output", a, "input").connect(costly, "output", b, "input")
    with run(spark, g) as found:
        assert len(found.kept) == 1
        assert all("InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString() for df in found.values())


def test_fusing_is_a_checked_hint(spark):
    a, b = src.IntRange(0, 3), op.Identity()
    g = Graph().pipeline(a, b)
    assert only(run(spark, g, fuse=[[a, b]])).count() == 3
    with pytest.raises(GraphError, match="not in the graph"):
        run(spark, g, fuse=[[op.Identity()]])


def test_load_graph(tmp_path):
    from streamloom.loader import load_graph

    text = "from streamloom.plans import Graph\nfrom streamloom.operators import Identity\nfrom streamloom.sources import Counter\ng = Graph().pipeline(Counter(), Identity())\n"
    (one := tmp_path / "one.py").write_text(text)
    (two := tmp_path / "two.py").write_text(text + "h = Graph().pipeline(Counter())\n")
    assert len(load_graph(str(one)).nodes) == 2 and len(load_graph(str(two), "h").nodes) == 1
    with pytest.raises(GraphError):
        load_graph(str(two))


def test_command_line(spark, tmp_path, capsys):
    from streamloom.__main__ import main

    text = "from streamloom.plans import Graph\nfrom streamloom.operators import Identity\nfrom streamloom.sources import Counter\ng = Graph().pipeline(Counter(name='P'), Identity(name='E'))\n"
    (path := tmp_path / "g.py").write_text(text)
    assert main(["batch", str(path), "--dot"]) == 0 and "digraph" in capsys.readouterr().out
    assert main(["batch", str(path), "-d", '{"P": 2}']) == 0
