"""The graph of partitions that a chain of joins connects, its paths and their weights.

Paths are rows with one partition id for each table. Weights are computed for pairs of partitions and joined to
paths, never for each path anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.samplers import weighted_order


def edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_pid, right_pid): every partition of one table with every one of the next; manifests, not rows."""
    return left.select(F.col("pid").alias("left_pid")).distinct().crossJoin(right.select(F.col("pid").alias("right_pid")).distinct())


def paths(hops: Sequence[DataFrame]) -> DataFrame:
    """(p0, p1, ...): all paths along consecutive edge tables (left_pid, right_pid)."""
    out = hops[0].select(F.col("left_pid").alias("p0"), F.col("right_pid").alias("p1"))
    for k, hop in enumerate(hops[1:], 2):
        out = out.join(hop.select(F.col("left_pid").alias(f"p{k - 1}"), F.col("right_pid").alias(f"p{k}")), f"p{k - 1}")
    return out.select(*(f"p{k}" for k in range(len(hops) + 1)))


def new_paths(all_paths: DataFrame, read: DataFrame) -> DataFrame:
    return all_paths.join(read, all_paths.columns, "left_anti")


def with_hop_sizes(all_paths: DataFrame, sizes: Sequence[DataFrame]) -> DataFrame:
    """Adds s0, s1, ...: the join size of each hop, 0 where the partitions do not meet."""
    out = all_paths
    for k, size in enumerate(sizes):
        out = out.join(size.select(F.col("left_pid").alias(f"p{k}"), F.col("right_pid").alias(f"p{k + 1}"), F.col("join_size").cast("long").alias(f"s{k}")), [f"p{k}", f"p{k + 1}"], "left")
    return out.fillna(0, [f"s{k}" for k in range(len(sizes))])


def live_paths(sized: DataFrame, hops: int) -> DataFrame:
    """Paths on which every hop joins something, with weight 1."""
    return sized.where(F.least(*(F.col(f"s{k}") for k in range(hops))) > 0 if hops > 1 else F.col("s0") > 0).withColumn("weight", F.lit(1.0))


def _ranged(df: DataFrame, *columns: str) -> DataFrame:
    """Adds the least and greatest value of columns, from an aggregate of one row."""
    ends = df.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    return df.join(F.broadcast(ends))  # one row


def _norm(c: str):
    lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def weight_by_size(sized: DataFrame, hops: int, middle: DataFrame, at: int = 1) -> DataFrame:
    """Half the normalised product of join sizes, half the normalised group count of the partition at ``at``.

    Hops without a row are left out of the product; a path whose size or group count is not above 0 has weight 0.
    """
    product = F.lit(1.0)
    for k in range(hops):
        product = product * F.when(F.col(f"s{k}") > 0, F.col(f"s{k}").cast("double")).otherwise(1.0)
    groups = middle.select(F.col("pid").alias(f"p{at}"), F.col("count_unique").cast("double").alias("n_groups"))
    both = sized.withColumn("size", product).join(groups, f"p{at}")
    weight = F.when((F.col("size") > 0) & (F.col("n_groups") > 0), 0.5 * _norm("size") + 0.5 * _norm("n_groups")).otherwise(0.0)
    return _ranged(both, "size", "n_groups").withColumn("weight", weight).drop(*(f"{c}__{e}" for c in ("size", "n_groups") for e in ("lo", "hi")))


def weight_by_groups(all_paths: DataFrame, middle: DataFrame, at: int = 1) -> DataFrame:
    return all_paths.join(middle.select(F.col("pid").alias(f"p{at}"), F.col("count_unique").cast("double").alias("weight")), f"p{at}")


def weight_by_zscore(all_paths: DataFrame, stats: Sequence[DataFrame]) -> DataFrame:
    """Half of 1 minus the normalised sum over hops of |difference of means| / sqrt(sum of errors), plus half."""
    out, z = all_paths, F.lit(0.0)
    for k, s in enumerate(stats):
        out = out.join(s.select(F.col("pid").alias(f"p{k}"), F.col("mean").alias(f"m{k}"), F.col("std_error").alias(f"e{k}")), f"p{k}")
    for k in range(len(stats) - 1):
        both = F.col(f"e{k}") + F.col(f"e{k + 1}")
        z = z + F.when(both > 0, F.abs(F.col(f"m{k}") - F.col(f"m{k + 1}")) / F.sqrt(both)).otherwise(0.0)
    return _ranged(out.withColumn("z", z), "z").withColumn("weight", 0.5 * (1 - _norm("z")) + 0.5).drop("z__lo", "z__hi")


def path_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "p" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def rank_paths(weighted: DataFrame, k: int) -> DataFrame:
    """The k heaviest paths, ties by partition ids."""
    return weighted.orderBy(F.desc("weight"), *path_columns(weighted)).limit(k)


def draw_paths(weighted: DataFrame, k: int, seed: int = 2) -> DataFrame:
    """k paths by weight without replacement, in the order drawn (``draw`` ascending); paths of weight 0 never."""
    ids = path_columns(weighted)
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids))
    return weighted_order(weighted, key, "weight").orderBy("draw", *ids).limit(k).select(*ids, "draw")


def random_paths(all_paths: DataFrame, k: int = 20, seed: int = 2) -> DataFrame:
    """k paths with equal chances, without replacement."""
    return draw_paths(all_paths.withColumn("weight", F.lit(1.0)), k, seed).drop("draw")


def paths_of_sizes(sizes: Sequence[DataFrame]) -> DataFrame:
    """Live paths with s0, s1, ..., built of the hops that join something; paths that do not are never made."""
    out = None
    for k, size in enumerate(sizes):
        hop = size.where("join_size > 0").select(F.col("left_pid").alias(f"p{k}"), F.col("right_pid").alias(f"p{k + 1}"), F.col("join_size").cast("long").alias(f"s{k}"))
        out = hop if out is None else out.join(hop, f"p{k}")
    return out.select(*(f"p{k}" for k in range(len(sizes) + 1)), *(f"s{k}" for k in range(len(sizes))))
