"""Connected components of a link table, by Spark joins.

Alternating large and small stars (Kiveris et al., "Connected Components in
MapReduce and Beyond"): every node sends its larger, then its smaller neighbours
to the smallest node it knows, until each component is a star around its
smallest node.  A node's neighbours are only ever summed up, never gathered, so a
hub costs no more than its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.llm.tables import stage


def _is_done(links: DataFrame) -> bool:
    """Whether every node has one link, but for the smaller ends, which have no smaller one themselves."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "of")
    larger = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("of"))
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
    moved = links.join(least, F.col("a") == F.col("of")).where(F.col("b") > F.col("least"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select(F.col("of").alias("a"), F.col("least").alias("b"))
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; `links` has the long columns a and b.

    The component is its smallest node.  Links to itself and nulls are ignored.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    )
    links = stage(links.distinct(), "links")
    while not _is_done(links):
        links = stage(_small_star(_large_star(links)), "links")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find within a task, over the numbers below n."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j
