"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmill.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return down.join(least, "a").select(ends, "m").select("a", F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links(a, b)``; a component is named by its smallest node.

    Nodes without a link are absent; links with a null end and links of a node with itself say nothing. A round is
    two aggregations, each combined before its shuffle, and two inner joins, whose frequent keys adaptive execution
    splits; the number of rounds grows with the logarithm of the longest chain. Each round's links are written to the
    shared folder. Only a count and a checksum of them reach the driver, to see that a round changed nothing.
    """

    def tidy(edges: DataFrame) -> DataFrame:
        return edges.filter("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = saved(tidy(links.select("a", "b")))
    before, now = None, mark(edges)
    while now[0] and now != before:
        edges = saved(tidy(_small_star(tidy(_large_star(edges)))))
        before, now = now, mark(edges)
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
