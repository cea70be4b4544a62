"""Nodes for streams: keyed state, running values, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..plans.node import Transform


class _Total(StatefulProcessor):
    """Keeps one number a key; for each row, in the order of ``order`` inside a micro-batch, emits the total so far."""

    def __init__(self, order: list[str], value: str | None):
        self.order, self.value = order, value

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "total double" if self.value else "total bigint")

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:
        import pandas as pd

        batch = pd.concat(list(rows), ignore_index=True)
        if self.order:
            batch = batch.sort_values(self.order, kind="stable")
        before = self.total.get()[0] if self.total.exists() else 0
        step = batch[self.value] if self.value else pd.Series(1, index=batch.index)
        batch["_total"] = before + step.cumsum()
        last = batch["_total"].iloc[-1]
        self.total.update((float(last),) if self.value else (int(last),))
        yield batch

    def close(self) -> None:
        pass


class StreamRunningCount(Transform):
    """For each row how often its key has come so far, across micro-batches (state in RocksDB)."""

    value: str | None = None
    keeps_state = True

    def __init__(self, key: str, order=(), name: str = "n", **kw):
        super().__init__(**kw)
        self.key, self.order, self.result = key, list(order), name

    def apply(self, df):
        columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        kind = "double" if self.value else "bigint"
        out = df.groupBy(self.key).transformWithStateInPandas(_Total(self.order, self.value), f"{columns}, _total {kind}", "Append", "None")
        return out.withColumnRenamed("_total", self.result)


class StreamRunningSum(StreamRunningCount):
    """For each row the sum of a column over its key so far."""

    def __init__(self, key: str, value: str, order=(), name: str = "total", **kw):
        super().__init__(key, order, name, **kw)
        self.value = value


class StreamCount(Transform):
    """Counts by key; on a stream for the modes update and complete (state in RocksDB, so keys need no memory)."""

    keeps_state = True

    def __init__(self, *keys: str, name: str = "n", **kw):
        super().__init__(**kw)
        self.keys, self.result = keys, name

    def apply(self, df):
        return df.groupBy(*self.keys).agg(F.count("*").alias(self.result))


class DailyWindow(Transform):
    """Counts and sums by key and event-time window, late data up to ``lateness`` (an extension)."""

    def __init__(self, time: str, key: str, value: str, width: str = "1 day", lateness: str = "1 day", **kw):
        super().__init__(**kw)
        self.time, self.key, self.value, self.width, self.lateness = time, key, value, width, lateness

    def apply(self, df):
        timed = df.withColumn("_time", F.col(self.time).cast("timestamp"))
        if df.isStreaming:
            timed = timed.withWatermark("_time", self.lateness)
        return (
            timed.groupBy(F.window("_time", self.width), self.key)
            .agg(F.count("*").alias("n"), F.sum(F.col(self.value).cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("day"), self.key, "n", F.col("total").cast("double").alias("total"))
        )
