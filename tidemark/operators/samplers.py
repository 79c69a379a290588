"""Row samplers. Those on hashes are reproducible; seeded ones depend on the partitioning."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import bucket, crc32_unit, md5_unit


def universe(df: DataFrame, key: Column, share: float, unit=md5_unit) -> DataFrame:
    """Rows whose key's hash is below ``share``; both sides of a join keep the same keys."""
    return df.where(unit(key) < share)


def universe_crc32(df: DataFrame, key: Column, share: float) -> DataFrame:
    return universe(df, key, share, crc32_unit)


def with_group(df: DataFrame, key: Column, groups: int) -> DataFrame:
    """Adds ``grp`` from 1 to ``groups``, uniform over keys."""
    return df.withColumn("grp", (F.floor(md5_unit(key) * groups) + 1).cast("int"))


def with_random_group(df: DataFrame, groups: int, seed: int = 2) -> DataFrame:
    return df.withColumn("grp", (F.floor(F.rand(seed) * groups) + 1).cast("int"))


def hash_range(df: DataFrame, key: Column, lo: int, hi: int) -> DataFrame:
    """Rows whose hundredth of the key's hash is in [lo, hi)."""
    b = bucket(md5_unit(key))
    return df.where((b >= lo) & (b < hi))


def stratified(df: DataFrame, column: str, share: float, seed: int = 2) -> DataFrame:
    """An equal share of each value's rows. A filter on a seeded draw: no list of values is collected."""
    return df.where(F.col(column).isNotNull() & (F.rand(seed) < share))


def stratified_hash(df: DataFrame, column: str, key: Column, share: float) -> DataFrame:
    """An equal share of each value's rows, drawn by a hash of value and key."""
    return df.where(F.col(column).isNotNull() & (md5_unit(F.concat_ws("|", F.col(column).cast("string"), key)) < share))


def bernoulli(df: DataFrame, share: float, seed: int = 2) -> DataFrame:
    return df.sample(share, seed)


def bernoulli_hash(df: DataFrame, key: Column, share: float) -> DataFrame:
    return df.where(md5_unit(F.concat(key.cast("string"), F.lit("|row"))) < share)


def weighted_order(df: DataFrame, key: Column, weight: str) -> DataFrame:
    """Adds ``draw``: in ascending order it is a weighted sample without replacement; weight 0 comes never."""
    u = (md5_unit(key) * 4294967296.0 + 0.5) / 4294967296.0
    return df.where(F.col(weight) > 0).withColumn("draw", -F.log(u) / F.col(weight))


def draws(weights: Mapping[object, float], seed: int = 2) -> Iterator[object]:
    """Keys one after another by weight, without replacement; for the partitions of a table."""
    rng, left = random.Random(seed), {k: w for k, w in weights.items() if w > 0}
    while left:
        key = min(left, key=lambda k: (-math.log(1 - rng.random()) / left[k], str(k)))
        del left[key]
        yield key
