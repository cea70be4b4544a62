"""Ports, nodes, graphs and their batch plans."""

from .graph import Composite, Edge, Graph, GraphError, composite
from .node import Node, Sink, Source, Transform
from .ports import ByKey, Grouping, Port, Shuffle, ToAll, ToOne, Unspecified, grouping_of
from .runner import Results, as_rows, bind_inputs, only, run

__all__ = [
    "ByKey", "Composite", "Edge", "Graph", "GraphError", "Grouping", "Node", "Port", "Results", "Shuffle", "Sink", "Source", "ToAll", "ToOne", "Transform", "Unspecified",
    "as_rows", "bind_inputs", "composite", "grouping_of", "only", "run",
]
