"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialise, temporary


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(few(down.groupBy("a").agg(F.min("b").alias("m"))))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has just one, and that one is a root: the components are told then."""
    up, down = edges.selectExpr("a as node", "1L as ups", "0 as root"), edges.selectExpr("b as node", "0L as ups", "1 as root")
    ends = up.union(down).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
    return ends.filter("ups > 1 or (ups = 1 and root = 1)").agg(F.count("*").alias("n")).first()["n"] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: bigint), root being the smallest node it reaches.

    Both steps take minima with map-side combining. The minima are written
    before they are joined: the join then reads two plain shuffles, so the
    adaptive planner splits a hub with very many neighbours (it can't split a
    side that is an aggregate). The number of rounds grows with the logarithm
    of the longest chain; each is written to the shared folder and the one
    before it is deleted. The steps keep components whole, so they end as soon
    as only stars are left, without a round that changes nothing.
    """
    spark = edges.sparkSession
    edges = materialise(few(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while not _stars(edges):
        with temporary(spark):
            edges = materialise(few(_small_star(materialise(few(_large_star(edges))))), keep=True)
    return edges.selectExpr("a as node", "b as root").union(edges.selectExpr("b as node", "b as root").distinct())
