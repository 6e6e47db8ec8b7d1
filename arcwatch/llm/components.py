"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of every node to its smallest neighbour.

    edges: (a, b) with a > b.  The small star joins a node's smaller
    neighbours and itself, the large star its larger neighbours.
    """
    if small:
        near = edges
    else:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    else:
        out = joined.filter("b > a").select(F.col("b").alias("x"), "m")
    return out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge.

    edges has two long columns; order, repeats and loops do not matter.  Each
    round is two aggregations and joins on node keys (nothing is gathered per
    component), and ends in a table; the number of rounds grows with the
    logarithm of the longest path.
    """
    x, y = edges.columns
    now = cut(edges.filter(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(rounds):
        mark = now.agg(digest.alias("d")).first()["d"]
        if mark == before:
            break
        before = mark
        now = cut(_star(_star(now, small=False), small=True), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
