"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forget, scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round over undirected links (u, v), both directions present.

    Every vertex u hands its neighbours the smallest id m of its neighbourhood: the larger ones (large
    star), or the smaller ones and itself (small star).
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u").where(F.col("v") > F.col("u") if large else F.col("v") <= F.col("u"))
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component_id): every linked id with the smallest id it can reach.

    Rounds run until every vertex points straight at its smallest id; each is a written table, so a lost
    executor costs one round. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = scratch(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = scratch(_star(both, True), "large-star")
        small = scratch(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "small-star")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.countDistinct("a")).first()
        forget(edges)
        forget(large)
        edges = small
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
            )
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
