"""Ranks and running values of ordered data in two steps, so that no task holds the whole order.

The order is cut at quantiles of its first column, found by one approximate
aggregate (a bounded list of boundaries, a scalar subquery of the same plan). A span between two boundaries is a
window partition; the totals of the spans before it (one row a span and key)
are added by a join. Equal values of the first column share a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = 64


def _spanned(df: DataFrame, by: str, spans: int) -> DataFrame:
    number = F.col(by).cast("double") if dict(df.dtypes)[by] != "timestamp_ntz" else F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    cuts = df.select(F.array_distinct(F.percentile_approx(number, [i / spans for i in range(1, spans)], 10_000)).alias("cuts")).scalar()
    bounds = F.coalesce(cuts, F.expr("cast(array() as array<double>)"))
    return df.withColumn("__bounds", bounds).withColumn("__span", F.size(F.filter("__bounds", lambda b: b < number))).drop("__bounds")


def running(df: DataFrame, part: list[str], order: list[str], sums: dict[str, Column], spans: int = SPANS) -> DataFrame:
    """Adds a running sum for each name: over ``part``, by ``order`` (whose first column must be a number or a time)."""
    df = _spanned(df, order[0], spans)
    keys = [*part, "__span"]
    before = Window.partitionBy(*part).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    for n in sums:
        totals = totals.withColumn(f"__{n}", F.sum(f"__{n}").over(before))
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__{n}" for n in sums])
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        df = df.withColumn(n, F.sum(c).over(here))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = df.join(F.broadcast(totals) if not part else totals, same)  # without keys: at most ``spans`` rows
    for n in sums:
        joined = joined.withColumn(n, F.coalesce(F.col(n) + F.col(f"__{n}"), F.col(n), F.col(f"__{n}")))
    return joined.drop("__span", *[f"__k{i}" for i in range(len(keys))], *[f"__{n}" for n in sums])


def ranks(df: DataFrame, part: list[str], order: list[str], name: str, spans: int = SPANS) -> DataFrame:
    """Adds the 1-based row number in ``part`` by ``order`` as bigint."""
    return running(df, part, order, {name: F.lit(1).cast("bigint")}, spans)
