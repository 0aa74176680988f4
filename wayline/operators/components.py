"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.sources.shared import discard, stored


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach, from undirected links (a, b).

    Alternates large-star and small-star steps, each one aggregation to a minimum and one join; rounds grow with the
    logarithm of a component, and are cut by a stored table.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        old, before = edges, mark
        edges = stored(_small_star(_large_star(old)), "links")
        mark = _mark(edges)
        discard(old)
        if mark == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sums of the links: the same for the same links."""
    sums = [F.sum(F.xxhash64(*cols).cast("decimal(38,0)")) for cols in (("u", "v"), ("v", "u"))]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
