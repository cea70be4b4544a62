"""Nodes without inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draw
from ..plans.node import Node, Source
from ..plans.runner import as_rows

#: fixed values: the words a random word is drawn from
WORDS = ("computer", "science", "stream", "node", "graph", "port", "edge")


def iterations(data, default: int = 1) -> int:
    """How often a root is asked for data: the number that was provided, else once."""
    return default if data is None else int(data)


class Rows(Source):
    """The units that the caller provides or that are given here; a number n stands for n empty iterations 0..n-1."""

    def __init__(self, units=None, schema=None, **kw):
        super().__init__(**kw)
        self.units, self.schema = units, schema

    def rows(self, spark, data):
        units = self.units if data is None else data
        if isinstance(units, int):
            return spark.range(units).withColumnRenamed("id", "value")
        return as_rows(spark, [] if units is None else units, self.schema)


class Iterations(Source):
    """n rows value = 0..n-1 for n iterations."""

    def rows(self, spark, data):
        return spark.range(iterations(data)).withColumnRenamed("id", "value")


class Counter(Node):
    """The k-th iteration sends k, from 1, to each of its outputs."""

    def __init__(self, outputs: int = 1, **kw):
        super().__init__((), ("output",) if outputs == 1 else tuple(f"output{i}" for i in range(outputs)), **kw)

    def build(self, spark, inputs, data=None):
        df = spark.range(1, iterations(data) + 1).withColumnRenamed("id", "value")
        return {p: df for p in self.outputs}


class Multiples(Source):
    """Iteration c, from 0, sends (c + 1) * i for i < count, as a record of one field."""

    def __init__(self, count: int, **kw):
        super().__init__(**kw)
        self.count = count

    def rows(self, spark, data):
        calls = spark.range(iterations(data)).withColumnRenamed("id", "c")
        return calls.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.count - 1).cast("bigint"))).alias("i"), "c").select(((F.col("c") + 1) * F.col("i")).alias("_0")) if self.count else calls.select(F.col("c").alias("_0")).limit(0)


class IntRange(Source):
    """start <= value < limit."""

    def __init__(self, start: int, limit: int, **kw):
        super().__init__(**kw)
        self.start, self.limit = start, limit

    def rows(self, spark, data):
        return spark.range(self.start, self.limit).withColumnRenamed("id", "value")


class Burst(Source):
    """n units 0..n-1 for every iteration."""

    def __init__(self, n: int = 10, **kw):
        super().__init__(**kw)
        self.n = n

    def rows(self, spark, data):
        return spark.range(iterations(data)).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.n - 1).cast("bigint"))).alias("value"))


class RandomWords(Source):
    """A word of seven an iteration, drawn by a seeded hash: the same on every run and retry."""

    def __init__(self, seed: int = 0, **kw):
        super().__init__(**kw)
        self.seed = seed

    def rows(self, spark, data):
        words = F.array(*[F.lit(w) for w in WORDS])
        return spark.range(iterations(data)).select("id", F.get(words, (draw(self.seed, "id") % len(WORDS)).cast("int")).alias("word"))


class Table(Source):
    """A Parquet table, or a DataFrame that is at hand; only the columns asked for."""

    def __init__(self, path_or_df, *columns: str, **kw):
        super().__init__(**kw)
        self.path_or_df, self.columns = path_or_df, columns

    def rows(self, spark, data):
        df = self.path_or_df if isinstance(self.path_or_df, DataFrame) else spark.read.parquet(self.path_or_df)
        return df.select(*self.columns) if self.columns else df


class Files(Source):
    """Any format that Spark reads (csv, json, orc, text, parquet, ...)."""

    def __init__(self, path: str, format: str, schema=None, options: dict | None = None, **kw):
        super().__init__(**kw)
        self.path, self.format, self.schema, self.options = path, format, schema, options or {}

    def rows(self, spark, data):
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(self.schema) if self.schema is not None else reader).load(self.path)


class TextLines(Source):
    """The lines of text files, stripped of white space at both ends; the path is given here or as the node's data."""

    def __init__(self, path: str | None = None, strip: bool = True, **kw):
        super().__init__(**kw)
        self.path, self.strip = path, strip

    def rows(self, spark, data):
        line = F.col("value")
        return spark.read.text(data or self.path).select((F.regexp_replace(line, r"^\s++|(?<!\s)\s++$", "") if self.strip else line).alias("line"))


class Traces(Source):
    """Signal samples as rows trace_id, n, x, sampling_rate: a prepared table, or files decoded by ``decode(bytes)``.

    ``decode`` returns (samples, sampling rate) of one file; its path is the trace_id.
    """

    costly = True

    def __init__(self, path: str, decode: Callable[[bytes], tuple] | None = None, **kw):
        super().__init__(**kw)
        self.path, self.decode = path, decode

    def rows(self, spark, data):
        if self.decode is None:
            return spark.read.parquet(self.path)
        decode = self.decode

        def read(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                for path, content in zip(batch["path"], batch["content"]):
                    x, rate = decode(bytes(content))
                    yield pd.DataFrame({"trace_id": path, "n": range(len(x)), "x": [float(v) for v in x], "sampling_rate": float(rate)})

        return spark.read.format("binaryFile").load(self.path).select("path", "content").mapInPandas(read, "trace_id string, n bigint, x double, sampling_rate double")


class Rate(Source):
    """An endless stream of numbers, so many a second."""

    def __init__(self, rows_per_second: int = 1, **kw):
        super().__init__(**kw)
        self.rows_per_second = rows_per_second

    def rows(self, spark, data):
        return spark.readStream.format("rate").option("rowsPerSecond", self.rows_per_second).load()


class StreamFrom(Source):
    """An endless stream of any format that Spark streams from (kafka, socket, ...).

    Back-pressure is the source's own option: maxOffsetsPerTrigger for Kafka,
    maxFilesPerTrigger for files.
    """

    def __init__(self, format: str, schema=None, **options):
        kw = {k: options.pop(k) for k in ("name", "instances") if k in options}
        super().__init__(**kw)
        self.format, self.schema, self.options = format, schema, options

    def rows(self, spark, data):
        reader = spark.readStream.format(self.format).options(**self.options)
        return (reader.schema(self.schema) if self.schema is not None else reader).load()


def python_source(generate: Callable[[int], Iterator[tuple]], schema: str, parts: int = 1) -> Source:
    """A source from a Python generator that is called once for each of ``parts`` partitions, on the executors."""

    class Generated(Source):
        costly = True

        def rows(self, spark: SparkSession, data) -> DataFrame:
            def run(batches):
                import pandas as pd

                for batch in batches:
                    for part in batch["id"]:
                        rows = list(generate(int(part)))
                        if rows:
                            yield pd.DataFrame(rows, columns=names)

            names = spark.createDataFrame([], schema).columns
            return spark.range(0, parts, 1, parts).mapInPandas(run, schema)

    return Generated()


