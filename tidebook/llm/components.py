"""Connected components of an edge list by alternating large-star and small-star steps.

Each step joins edges with the least neighbour of a node, so the neighbours of a hub are never brought
together; an iteration is written to the shared scratch folder, which cuts the lineage. Only counts and
checksums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch


def least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour. Edges come as u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = least_neighbour(edges)
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return smaller.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(node, root) of every node with an edge; ``root`` is the least node of its component.

    ``edges`` has columns a and b; loops and repeats are ignored.
    """
    now = scratch.put(f"{label}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, step = None, 0
    while True:
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
        if state == before or state[0] == 0:
            break
        before, step = state, step + 1
        now = scratch.put(f"{label}-{step}", small_star(large_star(now)))
        scratch.drop(f"{label}-{step - 1}")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
