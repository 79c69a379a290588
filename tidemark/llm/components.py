"""Connected components by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _toward_smallest_neighbour(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _toward_smallest_parent(edges: DataFrame) -> DataFrame:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for each end of an edge; root is the smallest node reachable.

    ``edges`` has long columns u and v; direction, repeats and loops do not matter. Each round is written
    to the shared folder; only a count and a checksum come to the driver. Rounds grow with the logarithm
    of the number of nodes. Minima are pre-aggregated before their shuffle and each join has one row per
    node on one side, so that adaptive execution can split a hot node's
    edges where they exceed its size thresholds; smaller stars stay in one task.
    """
    tag = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.bit_xor(F.xxhash64("u", "v"))).first()
    nodes = edges.select("u", "v").where("u is not null and v is not null")
    now = scratch.put(nodes.where("u <> v").distinct(), f"{name}0")
    seen, k = tag(now), 0
    while seen[0]:
        k += 1
        after = scratch.put(_toward_smallest_parent(_toward_smallest_neighbour(now)), f"{name}{k}")
        then = tag(after)
        scratch.drop(f"{name}{k - 1}")
        now, stable, seen = after, then == seen, then
        if stable:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
