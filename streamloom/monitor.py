"""Observing runs: row counts and times of nodes, and sizes of data."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .plans.node import Node, Transform


def logger(node: Node) -> logging.Logger:
    """The log of a node; on an executor its records carry the partition."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return logging.getLogger(f"streamloom.{node.id or node.name}" + (f".{context.partitionId()}" if context else ""))


class Timer:
    """Seconds of the block, as ``seconds``."""

    def __enter__(self) -> "Timer":
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self.began


class Observed(Transform):
    """Counts what passes, without a job of its own: read ``counts`` after an action ran."""

    def __init__(self, **kw):
        super().__init__(**kw)
        self.observation = Observation(f"rows of {self.name}")

    def apply(self, df):
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), F.min(F.current_timestamp()).alias("planned"))

    @property
    def counts(self) -> dict:
        return self.observation.get


class StreamProgress(StreamingQueryListener):
    """Rows and milliseconds of each micro-batch, by query: ``spark.streams.addListener(StreamProgress())``."""

    def __init__(self):
        self.batches: dict[str, list[tuple[int, int, int]]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.id), [])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.setdefault(str(p.id), []).append((p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def estimated_size(df: DataFrame) -> int:
    """Bytes that the optimizer expects the data to have."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
