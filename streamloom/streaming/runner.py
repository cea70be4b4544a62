"""Streaming runs: each result port of a graph becomes a streaming query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.graph import Graph
from ..plans.node import Source
from ..plans.runner import run

_STORE = "spark.sql.streaming.stateStore"
#: state on disk, and one bound for the memory of all stores of an executor
ROCKS = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.rocksdb.boundedMemoryUsage": "true"}


def state_folder(spark: SparkSession) -> str:
    """A fresh checkpoint folder in the shared folder of the session; in a temporary one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='streamloom-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


class BoundedStream(Source):
    """Files of a folder as a stream: ``pattern`` picks them by name (None: all), ``files_per_trigger`` limits a micro-batch."""

    def __init__(self, folder: str, pattern: str | None, schema, format: str = "parquet", files_per_trigger: int | None = None, **kw):
        super().__init__(**kw)
        self.folder, self.pattern, self.schema, self.format, self.files_per_trigger = folder, pattern, schema, format, files_per_trigger

    def rows(self, spark, data):
        reader = spark.readStream.format(self.format).schema(self.schema)
        if self.pattern:
            reader = reader.option("pathGlobFilter", self.pattern)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        return reader.load(self.folder)


class StreamRun:
    """The queries of a streaming run, by (node id, port)."""

    def __init__(self, queries: dict):
        self.queries = queries

    def wait(self, seconds: float | None = None) -> bool:
        """Waits until all queries ended (bounded sources end by themselves); False if one still runs."""
        return all(q.awaitTermination(seconds) if seconds is not None else (q.awaitTermination() or True) for q in self.queries.values())

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()


def run_stream(spark: SparkSession, graph: Graph, inputs=None, *, mode: str = "append", path: str | None = None, bounded: bool = True, sink=None) -> StreamRun:
    """Starts one query a result port.

    ``sink(df, batch_id)``, if given, gets every micro-batch, persisted for it:
    the way to feed several sinks from one stream. Else rows are written as
    Parquet below ``path``. ``bounded``: read what is there, flush, and end.
    """
    started = {}
    settings = ROCKS if any(getattr(n, "keeps_state", False) for n in graph.flatten().nodes) else {}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)  # a query takes the session's settings when it starts
    try:
        _start(spark, run(spark, graph, inputs), started, mode, path, bounded, sink)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return StreamRun(started)


def _start(spark: SparkSession, results, started: dict, mode: str, path: str | None, bounded: bool, sink) -> None:
    for (node, port), df in results.items():
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{state_folder(spark)}/{node}-{port}")
        if bounded:
            writer = writer.trigger(availableNow=True)
        if sink is not None:

            def each(batch: DataFrame, batch_id: int) -> None:
                batch.persist()
                try:
                    sink(batch, batch_id)
                finally:
                    batch.unpersist()

            writer = writer.foreachBatch(each)
        elif mode == "append":
            writer = writer.format("parquet").option("path", f"{path}/{node}-{port}")
        else:
            writer = writer.format("memory").queryName(f"q{uuid.uuid4().hex}")
        started[(node, port)] = writer.start()


def to_completion(spark: SparkSession, graph: Graph, inputs=None, *, mode: str = "append", seconds: float | None = None) -> DataFrame:
    """Runs a graph with one result over its bounded stream and returns the result as a batch DataFrame.

    It waits for the end, however long the stream is, or fails after ``seconds``.
    Append results are files in the shared folder; complete results (bounded by
    their number of groups) go through foreachBatch, the last batch winning.
    """
    folder = state_folder(spark)
    if mode == "append":
        done = run_stream(spark, graph, inputs, path=f"{folder}/out")
    else:
        done = run_stream(spark, graph, inputs, mode=mode, sink=lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/{k:09d}"))
    if not done.wait(seconds):
        done.stop()
        raise TimeoutError(f"the stream did not end in {seconds} s")
    ((key, query),) = done.queries.items()
    if query.exception() is not None:
        raise query.exception()
    if mode == "append":
        return spark.read.parquet(f"{folder}/out/{key[0]}-{key[1]}")
    last = max(p["batchId"] for p in query.recentProgress)
    for batch in range(last, -1, -1):
        try:
            return spark.read.parquet(f"{folder}/out/{batch:09d}")
        except Exception as e:  # a batch without new data writes nothing
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise RuntimeError("the stream made no batch")
