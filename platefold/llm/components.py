"""Connected components by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stage


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi <> lo")


def _large_star(edges: DataFrame, size: int, most: int) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.selectExpr("hi u", "lo v").unionByName(edges.selectExpr("lo u", "hi v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _ordered(join_hot(both.where("v > u"), least, ["u"], "n", total=2 * size, most=most).selectExpr("v u", "m v"))


def _small_star(edges: DataFrame, size: int, most: int) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; ``most`` bounds the smaller neighbours, as they are no more than before the large star."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(edges, least, ["hi"], "n", total=size, most=most).selectExpr("lo u", "m v")
    return _ordered(moved.unionByName(least.selectExpr("hi u", "m v")))


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least id reachable from node.

    Only nodes with a link to another one are returned; self links and nulls count for
    nothing.  Each round is two shuffles with partial aggregation, written to the shared folder, and the
    number of rounds grows with the logarithm of the longest path.
    """
    edges = stage(_ordered(links.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()).distinct(), "edges")
    for _ in range(max_rounds):
        ends = edges.selectExpr("hi node", "1 up").unionByName(edges.selectExpr("lo node", "0 up"))
        ends = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"))
        # settled: a node has one link to a lesser one, or only links to greater ones
        size, most, unsettled = ends.agg(F.sum("n") / 2, F.max("n"), F.count_if(F.expr("up > 1 or (up > 0 and up < n)"))).first()
        if not unsettled:
            return edges.selectExpr("hi node", "lo component").unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        edges = stage(_small_star(_large_star(edges, size, most), size, most).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
