"""Maps, filters, flat maps, port operators, and nodes with Python bodies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, split_words
from ..plans.graph import Composite, Graph
from ..plans.node import Node, Transform
from ..plans.ports import Shuffle


class Identity(Transform):
    """Passes everything on."""

    def apply(self, df):
        return df


class Apply(Transform):
    """value -> function(value, **params), a column function; null results are no units and are dropped, false, 0 and '' stay."""

    def __init__(self, function: Callable[..., Column], params: dict | None = None, column: str = "value", **kw):
        super().__init__(**kw)
        self.function, self.params, self.column = function, params or {}, column

    def apply(self, df):
        return df.withColumn(self.column, self.function(F.col(self.column), **self.params)).where(F.col(self.column).isNotNull())


class ApplyField(Transform):
    """Applies a column function to one field of a record and leaves the others as they are.

    ``field`` is a column, or a field of a struct column ('unit.x'). ``given``
    maps parameters of the function to other columns or fields of the record,
    which it gets besides ``params``.
    """

    def __init__(self, function: Callable[..., Column], field: str, params: dict | None = None, given: dict[str, str] | None = None, **kw):
        super().__init__(**kw)
        self.function, self.field, self.params, self.given = function, field, params or {}, given or {}

    def apply(self, df):
        value = self.function(F.col(self.field), **self.params, **{k: F.col(c) for k, c in self.given.items()})
        column, _, inner = self.field.partition(".")
        return df.withColumn(column, F.col(column).withField(inner, value) if inner else value)


class PythonApply(Transform):
    """The same with a Python function of one value: batches go through Arrow. ``returns`` is the result's type."""

    costly = True

    def __init__(self, function: Callable, returns: str, params: dict | None = None, column: str = "value", **kw):
        super().__init__(**kw)
        self.function, self.returns, self.params, self.column = function, returns, params or {}, column

    def apply(self, df):
        function, params = self.function, self.params

        @F.pandas_udf(self.returns)
        def mapped(values):
            import pandas as pd

            return pd.Series([None if v is None else function(v, **params) for v in values.astype(object).where(values.notna(), None)], dtype=object)

        mapped.func.__annotations__.clear()
        return df.withColumn(self.column, mapped(F.col(self.column))).where(F.col(self.column).isNotNull())


def chain(functions: list, prefix: str = "chain_", suffix: str = "", node: type[Transform] = Apply, column: str = "value") -> Composite:
    """A composite that applies functions, or (function, params) pairs, one after another; Spark folds them into one projection."""
    graph, nodes = Graph(), []
    for item in functions:
        function, params = item if isinstance(item, tuple) else (item, {})
        nodes.append(node(function, params, column=column, name=f"{prefix}{getattr(function, '__name__', 'function')}{suffix}"))
    graph.pipeline(*nodes)
    return Composite(graph, {"input": (nodes[0], "input")}, {"output": (nodes[-1], "output")}, name=f"{prefix}chain{suffix}")


class Where(Transform):
    """Keeps the rows for which a condition (SQL text, a column, or a function of the DataFrame) is true."""

    def __init__(self, condition, **kw):
        super().__init__(**kw)
        self.condition = condition

    def apply(self, df):
        return df.where(self.condition(df) if callable(self.condition) else self.condition)


class Select(Transform):
    """Any projection, as SQL texts."""

    def __init__(self, *expressions: str, **kw):
        super().__init__(**kw)
        self.expressions = expressions

    def apply(self, df):
        return df.selectExpr(*self.expressions)


class Tokenise(Transform):
    """line -> one row (word, 1) for each part between single blanks."""

    def __init__(self, column: str = "line", **kw):
        super().__init__(**kw)
        self.column = column

    def apply(self, df):
        return df.select(F.explode(split_words(F.col(self.column))).alias("word"), F.lit(1).cast("bigint").alias("n"))


class FlatMap(Transform):
    """One row for each element of an array expression."""

    def __init__(self, expression: str, output_column: str = "value", keep=(), **kw):
        super().__init__(**kw)
        self.expression, self.output_column, self.keep = expression, output_column, tuple(keep)

    def apply(self, df):
        return df.select(*self.keep, F.explode(F.expr(self.expression)).alias(self.output_column))


class Bernoulli(Transform):
    """Keeps a share of the rows, decided by a seeded hash of key columns: the same rows on every run, branch and retry."""

    def __init__(self, keys: list[str], share: float = 0.5, seed: int = 0, **kw):
        super().__init__(**kw)
        self.keys, self.share, self.seed = keys, share, seed

    def apply(self, df):
        return df.where(draw(self.seed, *self.keys) / F.lit(float(1 << 52)) < self.share)


class Delay(Transform):
    """Sleeps for every row (for tests of scheduling)."""

    costly = True

    def __init__(self, seconds: float, **kw):
        super().__init__(**kw)
        self.seconds = seconds

    def apply(self, df):
        seconds = self.seconds

        def sleep(batches: Iterator) -> Iterator:
            import time

            for batch in batches:
                time.sleep(seconds * len(batch))
                yield batch

        return df.mapInPandas(sleep, df.schema)


class Split(Node):
    """Several outputs from one input: each port gets the rows for which its condition is true."""

    def __init__(self, conditions: dict[str, str], **kw):
        super().__init__(("input",), tuple(conditions), **kw)
        self.conditions = conditions

    def build(self, spark, inputs, data=None):
        return {port: inputs["input"].where(c) for port, c in self.conditions.items()}


class Tagged(Node):
    """Several inputs as one stream of tagged rows: each unit arrives alone, with the port it came by in _port.

    This is a union, never a join: units of different ports do not meet.
    """

    def __init__(self, ports: list[str], **kw):
        super().__init__(tuple(ports), ("output",), **kw)

    def build(self, spark, inputs, data=None):
        tagged = [df.withColumn("_port", F.lit(port)) for port, df in inputs.items()]
        out = tagged[0]
        for df in tagged[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return {"output": out}


class ConcatPorts(Tagged):
    """value as text from whichever port has a unit; empty texts are no units."""

    def build(self, spark, inputs, data=None):
        texts = {p: df.select(F.col("value").cast("string").alias("value")) for p, df in inputs.items()}
        return {"output": super().build(spark, texts)["output"].select("value").where("value is not null and value <> ''")}


class PickPort(Transform):
    """The rows of one port of a tagged stream, without the tag."""

    def __init__(self, port: str, **kw):
        super().__init__(**kw)
        self.port = port

    def apply(self, df):
        return df.where(F.col("_port") == self.port).drop("_port")


class RenamePorts(Transform):
    """Renames the ports of a tagged stream; rows of ports that are not named are dropped."""

    def __init__(self, mapping: dict[str, str], **kw):
        super().__init__(**kw)
        self.mapping = mapping

    def apply(self, df):
        new = F.lit(None).cast("string")
        for old, name in self.mapping.items():
            new = F.when(F.col("_port") == old, F.lit(name)).otherwise(new)
        return df.withColumn("_port", new).where(F.col("_port").isNotNull())


class Sieve(Node):
    """Numbers from 2 up: a number that no smaller one divides goes to ``prime``, all others to ``output``.

    What a chain of stages does one divisor a stage is one anti join against
    the possible divisors, which are at most the square root of the largest
    number: ``limit`` bounds what is broadcast.
    """

    def __init__(self, limit: int, column: str = "value", **kw):
        super().__init__(("input",), ("prime", "output"), **kw)
        self.limit, self.column = limit, column

    def build(self, spark, inputs, data=None):
        df = inputs["input"]
        divisors = spark.range(2, int(self.limit**0.5) + 2).withColumnRenamed("id", "_d")
        hit = (F.col("_d") < F.col(self.column)) & (F.col(self.column) % F.col("_d") == 0)
        return {"prime": df.join(F.broadcast(divisors), hit, "left_anti"), "output": df.join(F.broadcast(divisors), hit, "left_semi")}


class PythonNode(Node):
    """A Python class with the life of a processing element, as a table function.

    ``body(**params)`` makes the object: its __init__ prepares, ``process(row)``
    returns an iterable of (port, tuple) pairs or None, and ``finish()`` does the
    same at the end of the data. One object sees all rows of a key (``keys``),
    or all rows (``keys`` empty: a single task), in the order of ``order``.
    With the grouping 'shuffle' of its input there is an object in each of
    ``instances`` tasks (else as many as the session shuffles into), which sees
    an equal share of the rows: for bodies to which it is all the same which
    rows they get. Every port has its own schema (DDL).
    """

    costly = True

    def __init__(self, body: Callable, ports: dict[str, str], keys=(), order=(), params: dict | None = None, **kw):
        super().__init__(("input",), tuple(ports), **kw)
        self.body, self.ports, self.keys, self.order, self.params = body, ports, list(keys), list(order), params or {}

    @property
    def dealt(self) -> bool:
        return isinstance(self.inputs["input"].grouping, Shuffle) and not self.keys and not self.order

    def build(self, spark, inputs, data=None):
        from pyspark.sql.functions import udtf

        body, params, index = self.body, self.params, {p: i for i, p in enumerate(self.ports)}
        schema = "_port string, " + ", ".join(f"_p{i} struct<{_fields(ddl)}>" for i, ddl in enumerate(self.ports.values()))

        class Element:
            def __init__(self):
                self.body = body(**params)

            def _rows(self, found):
                for port, unit in found or ():
                    if unit is not None:
                        out = [None] * len(index)
                        out[index[port]] = unit if isinstance(unit, tuple) else (unit,)
                        yield (port, *out)

            def eval(self, row):
                yield from self._rows(self.body.process(row))

            def terminate(self):
                yield from self._rows(self.body.finish() if hasattr(self.body, "finish") else ())

        df, element = inputs["input"], udtf(Element, returnType=schema)
        parts = self.instances or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.dealt:
            # the row as an argument: one object a task, nothing is gathered or sorted by key
            rows = df if self.instances else df.repartition(parts)
            tagged = rows.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).lateralJoin(element(F.col("_row").outer())).drop("_row")
        else:
            argument = df.asTable()
            argument = argument.partitionBy(*self.keys) if self.keys else argument.withSinglePartition()
            tagged = element(argument.orderBy(*self.order) if self.order else argument)
        self.shared = tagged  # one call makes all ports
        return {p: tagged.where(F.col("_port") == p).select(f"_p{i}.*") for p, i in index.items()}


def _fields(ddl: str) -> str:
    """'a bigint, b string' -> 'a: bigint, b: string' (flat types)."""
    return ", ".join(": ".join(part.strip().split(None, 1)) for part in ddl.split(","))


class SqlNode(Node):
    """SQL over the inputs, which are known by their port names (an extension)."""

    def __init__(self, sql: str, ports: list[str], **kw):
        super().__init__(tuple(ports), ("output",), **kw)
        self.sql = sql

    def build(self, spark, inputs, data=None):
        return {"output": spark.sql(self.sql, **inputs)}


class Join(Node):
    """A join of two inputs (an extension)."""

    def __init__(self, on, how: str = "inner", **kw):
        super().__init__(("left", "right"), ("output",), **kw)
        self.on, self.how = on, how

    def build(self, spark, inputs, data=None):
        return {"output": inputs["left"].join(inputs["right"], self.on, self.how)}


class TopK(Transform):
    """The first k rows of an order (an extension)."""

    def __init__(self, k: int, *order: str, **kw):
        super().__init__(**kw)
        self.k, self.order = k, order

    def apply(self, df: DataFrame):
        return df.orderBy(*[F.expr(o) if not o.lower().endswith(" desc") else F.expr(o[:-5]).desc() for o in self.order]).limit(self.k)


class SetOperation(Node):
    """intersect, except or union of two inputs, as sets or bags (an extension)."""

    def __init__(self, kind: str, distinct: bool = True, **kw):
        super().__init__(("left", "right"), ("output",), **kw)
        self.kind, self.distinct = kind, distinct

    def build(self, spark, inputs, data=None):
        a, b = inputs["left"], inputs["right"]
        if self.kind == "union":
            out = a.unionByName(b)
            return {"output": out.distinct() if self.distinct else out}
        if self.kind == "intersect":
            return {"output": a.intersect(b) if self.distinct else a.intersectAll(b)}
        return {"output": a.subtract(b) if self.distinct else a.exceptAll(b)}
