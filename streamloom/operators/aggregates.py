"""Aggregates. Spark plans each as partial and final aggregation; every node emits one row at the end of its data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.node import Transform
from ..plans.ordered import ranks, running


class Aggregate(Transform):
    """name -> aggregate column (or SQL text), of all rows or of each key."""

    def __init__(self, aggregates: dict[str, Column | str], keys=(), **kw):
        super().__init__(**kw)
        self.aggregates, self.keys = aggregates, list(keys)

    def columns(self) -> list[Column]:
        return [(F.expr(a) if isinstance(a, str) else a).alias(n) for n, a in self.aggregates.items()]

    def apply(self, df):
        return df.groupBy(*self.keys).agg(*self.columns())


def Count(name: str = "n", **kw) -> Aggregate:
    return Aggregate({name: F.count("*")}, **kw)


def Sum(*columns: str, **kw) -> Aggregate:
    """Sums by column; 0 without rows."""
    return Aggregate({f"sum_{c}": F.coalesce(F.sum(c), F.lit(0)) for c in columns}, **kw)


def Min(*columns: str, **kw) -> Aggregate:
    return Aggregate({f"min_{c}": F.min(c) for c in columns}, **kw)


def Max(*columns: str, floor_zero: bool = False, **kw) -> Aggregate:
    """Maxima; with ``floor_zero`` at least 0, as when a maximum starts from 0."""
    return Aggregate({f"max_{c}": F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)) if floor_zero else F.max(c) for c in columns}, **kw)


def Average(column: str, **kw) -> Aggregate:
    """Average, count and sum together; without rows null, 0 and 0."""
    return Aggregate({f"avg_{column}": F.avg(column), "n": F.count(column), f"sum_{column}": F.coalesce(F.sum(column), F.lit(0))}, **kw)


def StdDev(column: str, **kw) -> Aggregate:
    """Sample standard deviation, count, sum and sum of squares; of one row the deviation is null."""
    x = F.col(column)
    return Aggregate({f"stddev_{column}": F.stddev_samp(x), "n": F.count(x), f"sum_{column}": F.coalesce(F.sum(x), F.lit(0)), f"sum_sq_{column}": F.coalesce(F.sum(x * x), F.lit(0))}, **kw)


class PythonAggregate(Transform):
    """A user-defined aggregate: ``function`` takes the column's values of a key as a pandas Series."""

    costly = True

    def __init__(self, function: Callable, column: str, returns: str, keys=(), name: str = "value", **kw):
        super().__init__(**kw)
        self.function, self.column, self.returns, self.keys, self.result = function, column, returns, list(keys), name

    def apply(self, df):
        import pandas as pd

        function = self.function

        def reduced(values: pd.Series) -> object:
            return function(values)

        reduced.__annotations__ = {"values": pd.Series, "return": float}
        return df.groupBy(*self.keys).agg(F.pandas_udf(reduced, self.returns)(F.col(self.column)).alias(self.result))


class TwoPhase(Transform):
    """The general form: aggregates of each part of the data, then aggregates of those.

    ``partial`` and ``final`` map names to SQL aggregates; ``parts`` says how
    many parts (by hash of all columns) are reduced independently first.
    """

    def __init__(self, partial: dict[str, str], final: dict[str, str], parts: int = 32, keys=(), **kw):
        super().__init__(**kw)
        self.partial, self.final, self.parts, self.keys = partial, final, parts, list(keys)

    def apply(self, df):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(self.parts)).alias("_part")
        first = df.groupBy(*self.keys, part).agg(*[F.expr(a).alias(n) for n, a in self.partial.items()])
        return first.groupBy(*self.keys).agg(*[F.expr(a).alias(n) for n, a in self.final.items()])


class KeyedSum(Transform):
    """(word, n) -> word, count: keyed sums, at the end of the data."""

    def __init__(self, key: str = "word", value: str = "n", name: str = "count", **kw):
        super().__init__(**kw)
        self.key, self.value, self.result = key, value, name

    def apply(self, df):
        return df.groupBy(self.key).agg(F.sum(self.value).alias(self.result))


class Running(Transform):
    """A row for every input row with the sums so far, over all rows or per key, in a total order.

    The order must be given and start with a number or a time. It is summed in
    spans of the order, so no task holds all of it.
    """

    def __init__(self, sums: dict[str, Column], order: list[str], keys=(), **kw):
        super().__init__(**kw)
        self.sums, self.order, self.keys = sums, order, list(keys)

    def apply(self, df):
        return running(df, self.keys, self.order, self.sums)


class RunningCount(Transform):
    """A row for every input row with how often its key has occurred so far."""

    def __init__(self, key: str, order: list[str], name: str = "n", **kw):
        super().__init__(**kw)
        self.key, self.order, self.result = key, order, name

    def apply(self, df):
        return ranks(df, [self.key], self.order, self.result)
