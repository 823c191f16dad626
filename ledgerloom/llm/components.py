"""Connected components of a graph given as links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)).alias("h")).first()
    return r.n, r.h


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``links``: long columns a, b. Returns (id, component) of every id that has a link to another: the smallest id it can reach.

    A round turns each node's links towards the smallest neighbour; the links end as stars around the components' smallest
    ids. A node's minimum is a partial aggregate, and the join that spreads it can be split, so that a hub is no bottleneck.
    Each round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # Large star: a node's larger neighbours are linked to its smallest one instead.
        large = both.join(low, both.a == low.k).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large)
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large.a == low.k)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        new = scratch.keep(small)
        scratch.drop(edges, large)
        edges, before = new, state
        state = _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
