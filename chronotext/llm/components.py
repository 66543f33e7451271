"""Connected components of a graph of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent


def _least_to(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step: each node's chosen neighbours link to the least of its neighbourhood. Aggregates and joins only, so a hub is combined before it is shuffled and split after."""
    both = edges if not keep_larger else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    if keep_larger:
        least = cut(least)  # a plain shuffle on both sides of the join, so that a hub is split; smaller neighbours are few
    joined = both.join(least, "a")
    if keep_larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``node, component`` for each node that has a link; component is the least node reached.

    Null ends, self-links and repeated links change nothing. Ends when a round changes nothing.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    before = now = None
    while now is None or now != before:
        last, before = edges, now
        edges = cut(_least_to(_least_to(edges, True), False))
        spent(last)
        # Count and hash of the edges, which are distinct.
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    spent(edges)
    return out
