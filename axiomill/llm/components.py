"""Connected components by alternating large-star and small-star steps.

Edges stay a distributed table; each round is two grouped steps and ends in the checkpoint folder,
so lineage doesn't grow and a lost executor costs one round. Hubs are never gathered: a star step
joins each edge with its node's minimum instead of listing neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all ends of ``edges`` (columns a, b of one orderable type).

    ``component`` is the smallest node connected with ``node``. Self-loops and repeated edges are
    allowed; an end that is null drops its edge; no edges give no rows.
    """
    links = checkpointed(edges.select("a", "b").where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        before = signature(links)
        links = checkpointed(small_star(large_star(links)))
        if signature(links) == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).groupBy("node").agg(F.min("component").alias("component"))


def signature(links: DataFrame) -> tuple:
    """The number of edges and an order-free sum of their hashes."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = links.where("u <> v").select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionAll(links.where("u = v").select("u", "v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to its smallest neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    tied = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
