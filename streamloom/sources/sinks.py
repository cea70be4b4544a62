"""Nodes without outputs. They run when the results of a run are executed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.node import Sink


class Write(Sink):
    """Writes in any format, partitioned by columns if asked."""

    def __init__(self, path: str, format: str = "parquet", partition_by=(), mode: str = "error", options: dict | None = None, **kw):
        super().__init__(**kw)
        self.path, self.format, self.partition_by, self.mode, self.options = path, format, tuple(partition_by), mode, options or {}

    def consume(self, df):
        writer = df.write.format(self.format).mode(self.mode).options(**self.options)
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).save(self.path)
        return self.path


class PerKeyFiles(Write):
    """One folder of files for each value of a key, such as a trace."""

    def __init__(self, path: str, key: str = "trace_id", **kw):
        super().__init__(path, partition_by=(key,), **kw)


class Show(Sink):
    """Prints the first rows."""

    def __init__(self, rows: int = 20, **kw):
        super().__init__(**kw)
        self.rows = rows

    def consume(self, df):
        df.show(self.rows, truncate=False)


class LogLines(Sink):
    """Formats rows, by default as 'a: b' of the first two columns, and returns the first of them."""

    def __init__(self, pattern: str = "%s: %s", rows: int = 100, **kw):
        super().__init__(**kw)
        self.pattern, self.rows = pattern, rows

    def lines(self, df):
        count = self.pattern.replace("%%", "").count("%")
        return df.select(F.format_string(self.pattern, *[F.col(f"`{c}`").cast("string") for c in df.columns[:count]]).alias("line"))

    def consume(self, df):
        return [r["line"] for r in self.lines(df).limit(self.rows).collect()]


class Discard(Sink):
    """Computes every row and keeps none."""

    def consume(self, df):
        df.write.format("noop").mode("overwrite").save()
