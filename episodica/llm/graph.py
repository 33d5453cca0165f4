"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b: long): root is the least node that can be reached.

    Alternating large-star and small-star rounds until nothing changes; each round is written, so lineage stays short.
    A hub's minimum is pre-aggregated where its edges lie, and the join that hands it out splits skewed keys.
    Edges with a null end are left out; loops only make their node its own root.
    """
    nodes = edges.where("a is not null and b is not null")
    now = scratch.table(nodes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), thin=True)
    loops = now.where("a = b").select(F.col("a").alias("node"))
    state, links = _state(now.where("a <> b")), now
    while True:
        live = links.where("a <> b")
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        made = scratch.table(small.where("a <> b").distinct(), thin=True)
        seen = _state(made)
        if links is not now:
            scratch.drop(links)
        links = made
        if seen == state:
            break
        state = seen
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = roots.union(roots.select("root", "root")).union(loops.select("node", "node"))
    return every.groupBy("node").agg(F.min("root").alias("root"))
