"""Distributed union-find: connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u goes to the least of u and its neighbours. Small: so do u and its smaller ones."""
    e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-least")  # written, so that the join below can split a hub's edges
    met = e.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root): for each id in a link the least id of its component. Links are pairs of longs; nulls, loops and repeats are ignored.

    No id's links meet in one task: minima are combined before they are shuffled, and the joins can be split.
    """
    edges = staged(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    last = state(edges)
    for _ in range(rounds):
        if not last[0]:
            break
        edges = staged(_star(_star(edges, True), False), "star")
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
