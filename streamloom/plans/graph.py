"""Directed multigraphs of nodes, composites, and their DOT text."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from .node import Node


class GraphError(ValueError):
    """A graph that can't be planned: a cycle, an unknown port, a missing or conflicting schema."""


@dataclass(frozen=True)
class Edge:
    source: Node
    output: str
    target: Node
    input: str


class Graph:
    """Nodes get ids from their names and a number per graph, so plans are the same every time."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.edges: list[Edge] = []

    def add(self, node: Node) -> Node:
        if not any(n is node for n in self.nodes):
            self.nodes.append(node)
            node.id = f"{node.name}{len(self.nodes) - 1}"
        return node

    def connect(self, source: Node, output: str, target: Node, input: str) -> "Graph":
        """Adds an edge; the same edge twice delivers the data twice."""
        for node, port, side in ((source, output, "outputs"), (target, input, "inputs")):
            if port not in getattr(node, side):
                raise GraphError(f"{node!r} has no {side[:-1]} {port!r}")
        self.add(source)
        self.add(target)
        self.edges.append(Edge(source, output, target, input))
        return self

    def pipeline(self, *nodes: Node) -> "Graph":
        """Connects single-port nodes one after another."""
        if len(nodes) == 1:
            self.add(nodes[0])
        for a, b in zip(nodes, nodes[1:]):
            self.connect(a, next(iter(a.outputs)), b, next(iter(b.inputs)))
        return self

    def into(self, node: Node) -> list[Edge]:
        return [e for e in self.edges if e.target is node]

    def out_of(self, node: Node) -> list[Edge]:
        return [e for e in self.edges if e.source is node]

    def roots(self) -> list[Node]:
        return [n for n in self.nodes if not self.into(n)]

    def order(self) -> list[Node]:
        """Nodes, each after all that feed it; of independent ones the first added first."""
        waits = {id(n): len(self.into(n)) for n in self.nodes}
        ready = deque(n for n in self.nodes if not waits[id(n)])
        out = []
        while ready:
            node = ready.popleft()
            out.append(node)
            for e in self.out_of(node):
                waits[id(e.target)] -= 1
                if not waits[id(e.target)]:
                    ready.append(e.target)
        if len(out) < len(self.nodes):
            raise GraphError(f"cycle through {[n for n in self.nodes if n not in out]}")
        return out

    def flatten(self) -> "Graph":
        """A graph without composites: their inner nodes take their place, at any depth, with all their edges."""
        flat = Graph()
        ends: dict[tuple, list] = {}  # (composite, side, port) -> inner (node, port) pairs

        def place(graph: Graph) -> None:
            for node in graph.nodes:
                if isinstance(node, Composite):
                    place(node.graph)
                    ends.update({(id(node), "in", k): resolved("in", v) for k, v in node.input_map.items()})
                    ends.update({(id(node), "out", k): resolved("out", v) for k, v in node.output_map.items()})
                else:
                    flat.add(node)
            for e in graph.edges:
                for s, o in resolved("out", [(e.source, e.output)]):
                    for t, i in resolved("in", [(e.target, e.input)]):
                        flat.connect(s, o, t, i)

        def resolved(side: str, pairs) -> list:
            out = []
            for node, port in pairs:
                out += ends[(id(node), side, port)] if isinstance(node, Composite) else [(node, port)]
            return out

        place(self)
        return flat

    def propagate_types(self) -> dict[tuple[str, str], object]:
        """Schema of each (node id, port): declared ones, or the source's where an output declares none.

        An input must find a schema upstream or declare one; a declared input
        must be fed the column names it declares.
        """
        flat, known = self.flatten(), {}
        for node in flat.order():
            fed = {}
            for name, port in node.inputs.items():
                schemas = [known[(e.source.id, e.output)] for e in flat.into(node) if e.input == name]
                schema = port.schema or next((s for s in schemas if s is not None), None)
                if schema is None and schemas:
                    raise GraphError(f"no type reaches {node!r}.{name}")
                for s in schemas:
                    if s is not None and port.schema is not None and set(s.fieldNames()) != set(port.schema.fieldNames()):
                        raise GraphError(f"{node!r}.{name} takes {port.schema.fieldNames()}, not {s.fieldNames()}")
                fed[name] = known[(node.id, name)] = schema
            for name, port in node.outputs.items():
                known[(node.id, name)] = port.schema or next((s for s in fed.values() if s is not None), None)
        return known

    def to_dot(self) -> str:
        """Graphviz text; a composite is a cluster."""
        lines = ["digraph dataflow {", "  rankdir=LR;", "  node [shape=record];"]
        seen: set[int] = set()

        def quoted(text: str) -> str:
            return '"' + text.replace('"', r"\"") + '"'

        def key(node: Node) -> str:
            return f"n{id(node)}"

        def draw(graph: Graph, pad: str) -> None:
            for node in graph.nodes:
                if id(node) in seen:
                    continue
                seen.add(id(node))
                if isinstance(node, Composite):
                    lines.append(f"{pad}subgraph cluster_{id(node)} {{")
                    lines.append(f"{pad}  label={quoted(node.name)};")
                    draw(node.graph, pad + "  ")
                    lines.append(f"{pad}}}")
                else:
                    ins = "|".join(f"<in_{p}> {p}" for p in node.inputs)
                    outs = "|".join(f"<out_{p}> {p}" for p in node.outputs)
                    lines.append(f"{pad}{key(node)} [label={quoted(f'{{{{{ins}}}|{node.name}|{{{outs}}}}}')}];")

        draw(self, "  ")
        for e in self.flatten().edges:
            lines.append(f"  {key(e.source)}:out_{e.output} -> {key(e.target)}:in_{e.input};")
        return "\n".join([*lines, "}"])


class Composite(Node):
    """A graph that is used as one node; each of its ports stands for ports of inner nodes."""

    def __init__(self, graph: Graph, inputs: dict, outputs: dict, *, name: str | None = None):
        super().__init__(tuple(inputs), tuple(outputs), name=name)
        self.graph = graph
        as_list = lambda v: list(v) if isinstance(v, list) else [v]
        self.input_map = {k: as_list(v) for k, v in inputs.items()}
        self.output_map = {k: as_list(v) for k, v in outputs.items()}


def composite(create, *args, name: str | None = None, **params) -> Composite:
    """From a function that returns (graph, inputs, outputs)."""
    graph, inputs, outputs = create(*args, **params)
    return Composite(graph, inputs, outputs, name=name or create.__name__)
