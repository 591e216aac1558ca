"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b) edges with a > b.

    Every node's neighbours are linked to the smallest of them and the node: for
    ``large`` the larger neighbours, else the smaller ones and the node itself.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    if large:
        # the larger neighbours b of a go to m; they are the edges (b, a), b > a
        out = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
    else:
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest id reachable from every node of a link table.

    Alternates large and small stars, which take a number of rounds logarithmic in the
    size of a component, until the edges stay as they are. Every step is a grouped
    minimum with map-side combining and a join; each round is checkpointed, so a lost
    executor costs one round. Self-links and repeated links are harmless; nodes without
    a link to another node are not in the result.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    )
    before = None
    while True:
        edges = checkpointed(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
