"""Connected components of an undirected graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1_000_003)), F.sum(F.col("b") % F.lit(1_000_003))).first())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    Every round aggregates minima only, so a node with many links is never gathered, and writes minima and links to the shared
    folder. The minima are read again for their join, so that Spark sees two plain shuffles there and can split a node of very
    many links (adaptive skew join). Rounds grow with the logarithm of the longest chain. Null ends, loops and repeated links are ignored.
    """
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), (F.col(left) != F.col(right)).alias("apart")).filter("apart").drop("apart")
    edges = materialise(edges.distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # Large star: neighbours above a node hang on the smallest of its neighbourhood.
        large = materialise(both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        # Small star: neighbours below a node, and the node, hang on the smallest of them.
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over arbitrary hashable nodes; the smallest of a set is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
