"""Helpers shared by the corpus operators: shared storage, row numbers, dense names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: shuffle partitions whose rows share a file in what few() takes together
FEW = 8
#: folders of the temporary() blocks that are open, innermost last
_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master runs in this process (tests) a
    temporary folder of this machine is taken, once a session.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="streamloom-"))
    return sc.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streamloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has materialised. Results that were not written yet can't be read after it."""
    _delete(spark, _own_folder(spark))


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is materialised in this block is deleted at its end, but for ``materialise(df, keep=True)``."""
    folder = f"{_open[-1] if _open else _own_folder(spark)}/{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield
    finally:
        _open.pop()
        _delete(spark, folder)


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; with ``keep`` it outlives the innermost temporary().

    Cuts the lineage, fixes non-deterministic columns such as row numbers, and
    survives the loss of any executor. Unlike ``checkpoint()`` it is columnar
    and compressed, so later reads prune columns.
    """
    spark = df.sparkSession
    scopes = [_own_folder(spark), *_open]
    path = f"{scopes[-2] if keep and len(scopes) > 1 else scopes[-1]}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """A small aggregate in fewer tasks, to be written in fewer files: a file takes longer than its rows.

    FEW shuffle partitions go to a task, but there are as many tasks as cores.
    The stage that makes ``df`` must hold no join, whose split skewed
    partitions would meet again; the stages before it keep their tasks.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // FEW)))


def numbered(df: DataFrame, name: str = "uid") -> DataFrame:
    """A written copy of ``df`` with a number ``name`` for each row.

    Numbers are taken once and written: taken anew in another pass they would
    follow the partitions of that pass, which change with the cluster's size.
    """
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))


def dense_names(rows: DataFrame, keys: list[str], name: str = "name", by: str | None = None) -> DataFrame:
    """Distinct ``rows`` with the number, from 0, of each in the order of ``keys``: the same however rows are partitioned.

    Rows are range-partitioned and sorted; a number is that in its partition
    plus the rows of the partitions before (one total a partition). ``by`` is
    the SQL of a short number that goes before long keys: the sample from which
    Spark finds the ranges, which goes to the driver, then holds no texts.
    """
    rows = rows.withColumn("__by", F.expr(by)) if by else rows
    first = ["__by"] if by else keys
    sorted_ = rows.repartitionByRange(*first).sortWithinPartitions(*dict.fromkeys(first + keys))
    placed = materialise(sorted_.withColumn("__at", F.monotonically_increasing_id()).drop("__by"))
    part = F.shiftright("__at", 33)
    totals = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition, so one task may order them
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")))
    inside = F.col("__at") - F.shiftleft(F.col("__part"), 33)
    return placed.join(F.broadcast(first), part == F.col("__part")).withColumn(name, F.col("__first") + inside).drop("__at", "__part", "__first")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
