"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reached) of links ``a, b`` between different nodes.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every step joins nothing
    and only takes minima of groups, so hot nodes cost partial sums. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{name}0")
    before = None
    for n in range(1, most_rounds + 1):
        # large star: greater neighbours of u move to the least of u and its neighbours
        near = both(edges)
        low = least(near).select("u", F.least("u", "m").alias("m"))
        large = near.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        # small star: u and its lesser neighbours move to the least of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = least(down)
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select("m", "u")).filter("a < b").distinct()
        edges = scratch.keep(small, f"{name}{n}")
        scratch.drop(f"{name}{n - 1}")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        # a star is a fixed point: if no node is both a centre and a leaf, each leaf having one centre
        if edges.select(F.col("b").alias("x")).join(edges.select(F.col("a").alias("x")), "x", "left_semi").isEmpty() and state[0] == edges.select("b").distinct().count():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
