"""Connected components of an edge table, distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) on DataFrames: every step is a grouped minimum, which Spark
pre-aggregates before its shuffle, and a join, which AQE splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import Scratch

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the least node around it."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    greater = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return greater.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (u, v: long).

    Self-loops and repeated edges are harmless; an edge table without rows gives none.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = scratch.save(now, f"{name}-0")
    before = None
    for k in range(1, MOST_ROUNDS):
        # distinct edges with the same sum of hashes twice in a row: the stars no longer move
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        after = scratch.save(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = after
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
