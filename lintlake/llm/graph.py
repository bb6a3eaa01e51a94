"""Connected components of links, by contraction of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links` (`a`, `b` long): root is the smallest node it reaches.

    Large and small stars take turns, each of them hanging neighbours under the smallest one in sight, until
    every node points at its root; the number of rounds grows with the logarithm of the longest chain.  Every
    round is a few grouped minimums and joins over the links and is written to the shared folder.  A node with
    very many neighbours is one row of the minimum; its links are rows of a join that Spark splits.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    hung = edges.join(low, "u")
    moved = hung.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low).distinct()
