"""Batch runs: a graph becomes one lazy DataFrame per result port."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .graph import Graph, GraphError
from .node import Node, Sink


class Results(dict):
    """(node id, port) -> DataFrame, lazily; sinks wait for ``execute``. Close it to free what was persisted."""

    def __init__(self):
        super().__init__()
        self.sinks: list[tuple[Sink, DataFrame]] = []
        self.kept: list[DataFrame] = []

    def of(self, node: Node, port: str = "output") -> DataFrame:
        return self[(node.id, port)]

    def execute(self) -> dict[str, object]:
        """Runs the sinks in order; what each returned, by its id."""
        return {node.id: node.consume(df) for node, df in self.sinks}

    def collect(self) -> dict[str, dict[str, list]]:
        """All result rows on the driver, for small results."""
        out: dict[str, dict[str, list]] = {}
        for (node, port), df in self.items():
            out.setdefault(node, {})[port] = df.collect()
        return out

    def stream(self) -> Iterator[tuple[str, str, object]]:
        """(node id, port, row) one at a time, a partition in the driver's memory at once."""
        for (node, port), df in self.items():
            for row in df.toLocalIterator():
                yield node, port, row

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    def __enter__(self) -> "Results":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def bind_inputs(graph: Graph, inputs: Mapping | None) -> dict[int, object]:
    """What is provided for each node: keys are nodes, names or ids (in this order of precedence)."""
    bound = {}
    for node in graph.nodes:
        for key in (node, node.name, node.id):
            if inputs and key in inputs:
                bound[id(node)] = inputs[key]
                break
    known = {k for n in graph.nodes for k in (n, n.name, n.id)}
    for key in inputs or ():
        if key not in known:
            raise GraphError(f"input for {key!r}, which is not in the graph")
    return bound


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def as_rows(spark: SparkSession, data, schema=None) -> DataFrame:
    """A DataFrame from what a caller provides: a DataFrame, a list of units, or a path of a text file."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.read.text(data)
    rows = list(data)
    if rows and not isinstance(rows[0], (tuple, list, dict)):
        rows = [(x,) for x in rows]
        schema = schema or ["value"]
    elif rows and isinstance(rows[0], (tuple, list)):
        schema = schema or [f"_{i}" for i in range(len(rows[0]))]
    if not rows:
        return spark.createDataFrame([], schema or "value bigint")
    return spark.createDataFrame(rows, schema)


def run(spark: SparkSession, graph: Graph, inputs: Mapping | None = None, results: Mapping | None = None, fuse: list[list[Node]] | None = None) -> Results:
    """Builds the plan. Results are all unconnected outputs or, if ``results`` (node -> ports) is given, just those.

    Edges that meet in one input port are united. Data provided for a node
    with inputs is united with what reaches its (first) input; for a root it is
    its data. A costly node with several edges out is persisted once, and so is
    what a node makes several used ports from.

    ``fuse`` (groups of nodes to run together) is accepted as a hint and only
    checked: Spark fuses whatever lies between two exchanges by itself.
    """
    flat = graph.flatten()
    for node in (n for group in fuse or () for n in group):
        if not any(n is node for n in flat.nodes):
            raise GraphError(f"{node!r} is not in the graph")
    bound = bind_inputs(flat, inputs)
    made: dict[tuple[int, str], DataFrame] = {}
    out = Results()
    for node in flat.order():
        fed: dict[str, DataFrame] = {}
        for name, port in node.inputs.items():
            frames = [made[(id(e.source), e.output)] for e in flat.into(node) if e.input == name]
            if id(node) in bound and name == next(iter(node.inputs)):
                frames.append(as_rows(spark, bound[id(node)], port.schema))
            if frames:
                fed[name] = port.grouping.deal(_union(frames), node.instances)
        if node.inputs and not fed:
            raise GraphError(f"nothing reaches {node!r}")
        if isinstance(node, Sink):
            out.sinks.append((node, next(iter(fed.values()))))
            continue
        ports = node.build(spark, fed, bound.get(id(node)))
        if node.shared is not None:
            if _uses(flat, node, results) > 1 and not node.shared.isStreaming:
                out.kept.append(node.shared.persist(StorageLevel.MEMORY_AND_DISK))
        for name, df in ports.items():
            if node.shared is None and node.costly and sum(e.output == name for e in flat.out_of(node)) > 1 and not df.isStreaming:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                out.kept.append(df)
            made[(id(node), name)] = df
    if results is not None:
        for node, ports in results.items():
            for port in [ports] if isinstance(ports, str) else ports:
                out[(node.id, port)] = made[(id(node), port)]
    else:
        connected = {(id(e.source), e.output) for e in flat.edges}
        for node in flat.nodes:
            for port in node.outputs:
                if (id(node), port) in made and (id(node), port) not in connected:
                    out[(node.id, port)] = made[(id(node), port)]
    return out


def _uses(graph: Graph, node: Node, results: Mapping | None) -> int:
    """How many edges leave a node, with the ports of it that are results."""
    edges = graph.out_of(node)
    if results is None:
        return len(edges) + len(set(node.outputs) - {e.output for e in edges})
    asked = results.get(node, ())
    return len(edges) + len([asked] if isinstance(asked, str) else asked)


def only(results: Results) -> DataFrame:
    """The DataFrame of a run with one result port."""
    if len(results) != 1:
        raise GraphError(f"{len(results)} results: {list(results)}")
    return next(iter(results.values()))
