"""Connected components of an edge table by alternating large-star and small-star contractions.

No neighbourhood is ever gathered: both steps are a minimum for each node (combined before the shuffle) and a join, so a
node with very many neighbours is an ordinary skewed join, whose rows are dealt out (``join_uneven``). The number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_uneven


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    return join_uneven(both.where("v > u"), least.drop("n"), "u", least.select("u", "n"), total=2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = join_uneven(down, least.drop("n"), "u", least.select("u", "n"), total=total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) in either direction to (node, root): root is the least node that node reaches.

    Loops u = v and repeated edges are allowed, edges with a null end are none; nodes whose only edge is a loop do not
    appear; no edges give no rows; other columns are ignored.
    """
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = durable(_small_star(_large_star(edges, now[0]), now[0]))
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
