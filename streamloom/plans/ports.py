"""Ports and the ways data is dealt to the instances of a node."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Grouping:
    """How the rows that reach an input port are distributed."""

    def deal(self, df: DataFrame, instances: int | None) -> DataFrame:
        return df


@dataclass(frozen=True)
class Unspecified(Grouping):
    """No distribution of its own: whatever the plan has."""


@dataclass(frozen=True)
class Shuffle(Grouping):
    """Round robin, so that instances get equal shares."""

    def deal(self, df, instances):
        return df.repartition(instances) if instances else df


@dataclass(frozen=True)
class ByKey(Grouping):
    """Rows with equal keys meet in one instance; keys are column names or positions."""

    keys: tuple

    def columns(self, df: DataFrame) -> list[str]:
        return [df.columns[k] if isinstance(k, int) else k for k in self.keys]

    def deal(self, df, instances):
        cols = [F.col(f"`{c}`") for c in self.columns(df)]
        return df.repartition(instances, *cols) if instances else df.repartition(*cols)


@dataclass(frozen=True)
class ToOne(Grouping):
    """All rows go to one instance. Use an aggregate instead where one exists: this is one task."""

    def deal(self, df, instances):
        return df.coalesce(1)


@dataclass(frozen=True)
class ToAll(Grouping):
    """Every instance gets a copy of every row: that of instance i, marked by the column _instance, is in partition i."""

    def deal(self, df, instances):
        n = instances or 1
        copies = df.withColumn("_instance", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return copies if df.isStreaming else copies.repartitionById(n, F.col("_instance"))


def grouping_of(spec) -> Grouping:
    """From a Grouping, None, 'shuffle', 'global', 'all', 'none', or a list of key positions or names."""
    if isinstance(spec, Grouping):
        return spec
    if isinstance(spec, (list, tuple)):
        return ByKey(tuple(spec))
    named = {None: Unspecified(), "none": Unspecified(), "shuffle": Shuffle(), "global": ToOne(), "all": ToAll()}
    if spec not in named:
        raise ValueError(f"unknown grouping {spec!r}")
    return named[spec]


@dataclass(frozen=True)
class Port:
    name: str
    schema: StructType | None = None
    grouping: Grouping = Unspecified()
