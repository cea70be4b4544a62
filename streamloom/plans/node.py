"""Nodes: named ports and a function from input DataFrames to output DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .ports import Port, grouping_of


class Node:
    """A processing element. Subclasses implement ``build``; nothing runs until an action asks for rows.

    ``instances`` is a hint for the number of partitions after a grouping.
    ``costly`` nodes (Python or not repeatable) are persisted where several
    edges leave them, so every branch sees the same rows. A node that makes
    several ports from one table puts that table in ``shared`` instead.
    """

    costly = False
    shared: DataFrame | None = None

    def __init__(self, inputs=(), outputs=(), *, name: str | None = None, instances: int | None = None):
        self.inputs: dict[str, Port] = {p.name: p for p in map(self._port, inputs)}
        self.outputs: dict[str, Port] = {p.name: p for p in map(self._port, outputs)}
        self.name = name or type(self).__name__
        self.instances = instances
        self.id: str | None = None  # given by the graph

    @staticmethod
    def _port(spec) -> Port:
        if isinstance(spec, Port):
            return spec
        if isinstance(spec, str):
            return Port(spec)
        name, grouping = spec
        return Port(name, grouping=grouping_of(grouping))

    def group(self, port: str, grouping) -> "Node":
        """Sets how rows that reach an input are dealt; returns the node."""
        old = self.inputs[port]
        self.inputs[port] = Port(old.name, old.schema, grouping_of(grouping))
        return self

    def build(self, spark: SparkSession, inputs: Mapping[str, DataFrame], data=None) -> dict[str, DataFrame]:
        """Output port -> DataFrame. ``data`` is what the caller provided for a root node."""
        raise NotImplementedError

    def __repr__(self) -> str:
        return f"<{self.id or self.name}>"


class Source(Node):
    """No inputs, one output."""

    def __init__(self, output: str = "output", **kw):
        super().__init__((), (output,), **kw)

    def rows(self, spark: SparkSession, data) -> DataFrame:
        raise NotImplementedError

    def build(self, spark, inputs, data=None):
        return {p: self.rows(spark, data) for p in self.outputs}


class Transform(Node):
    """One input, one output."""

    def __init__(self, *, input: str = "input", output: str = "output", **kw):
        super().__init__((input,), (output,), **kw)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def build(self, spark, inputs, data=None):
        (i,), (o,) = self.inputs, self.outputs
        return {o: self.apply(inputs[i])}


class Sink(Node):
    """One input, no output; ``consume`` runs when the results are executed."""

    def __init__(self, *, input: str = "input", **kw):
        super().__init__((input,), (), **kw)

    def consume(self, df: DataFrame):
        raise NotImplementedError

    def build(self, spark, inputs, data=None):
        return {}
