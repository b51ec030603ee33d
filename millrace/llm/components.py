"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v.

    Both take a node's least neighbour by an aggregation and join it back, so a node with very many neighbours is
    aggregated where its edges lie and its join can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    parent = large.groupBy("u").agg(F.min("v").alias("m"))
    hooked = large.join(parent, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(parent.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of a link but the roots themselves; the root is the component's least node.

    Links may be repeated and point either way; those of a node with itself or with NULL say nothing.  Rounds grow
    with the logarithm of the longest path, and each is written to the shared scratch folder.
    """
    u, v = F.col(a), F.col(b)
    edges = materialize(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(seen)
        edges = materialize(_stars(edges))
