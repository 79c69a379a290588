"""Statistics and sketches of partitions, all in one aggregation over the table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import md5_bits

DEPTH = 5


def partition_statistics(df: DataFrame, column: str) -> DataFrame:
    """(pid, mean, std_error, count_unique) of the hash of ``column`` in [0, 1); an empty mean is 0.

    The sums are of integers, so the result does not depend on the order of rows.
    """
    h = md5_bits(F.col(column)).cast("decimal(20,0)")
    n = F.count(column)
    sums = df.groupBy("pid").agg(n.alias("n"), F.sum(h).cast("double").alias("s"), F.sum(h * h).cast("double").alias("q"), F.count_distinct(column).alias("count_unique"))
    unit = F.lit(4294967296.0)
    mean = F.col("s") / F.col("n") / unit
    variance = F.greatest(F.lit(0.0), F.col("q") / F.col("n") / unit / unit - mean * mean)
    return sums.select("pid", F.coalesce(mean, F.lit(0.0)).alias("mean"), F.when(F.col("n") > 0, F.sqrt(variance) / F.sqrt("n")).alias("std_error"), "count_unique")


def count_min(df: DataFrame, column: str, width: int = 4096, depth: int = DEPTH, share: float = 1.0) -> DataFrame:
    """A count-min sketch of each partition in long form: (pid, depth, cell, n).

    Both halves of a key's MD5 make the cells of all depths. A cell overestimates by more than e / width of the rows
    with a chance of e ** -depth at most.
    """
    rows = df.where(F.col(column).isNotNull())
    if share < 1:
        rows = rows.sample(share, 1)
    a, b = F.col("a"), F.col("b")
    cells = F.array(*(F.struct(F.lit(d).alias("depth"), F.pmod(a + d * b, F.lit(width)).alias("cell")) for d in range(depth)))
    hashed = rows.select("pid", md5_bits(F.col(column)).alias("a"), md5_bits(F.col(column), 1).alias("b"))
    return hashed.select("pid", F.inline(cells)).groupBy("pid", "depth", "cell").agg(F.count("*").alias("n"))


def sketch_shape(eps: float, delta: float) -> tuple[int, int]:
    """Width and depth for an error of at most ``eps`` of the rows with a chance of at least 1 - ``delta``."""
    return math.ceil(math.e / eps), max(1, math.ceil(math.log(1 / delta)))


def heavy_hitters(df: DataFrame, column: str, share: float) -> DataFrame:
    """(pid, value, n): values that make at least ``share`` of a partition's rows, exact."""
    counts = df.where(F.col(column).isNotNull()).groupBy("pid", F.col(column).alias("value")).agg(F.count("*").alias("n"))
    rows = counts.groupBy("pid").agg(F.sum("n").alias("rows"))
    return counts.join(rows, "pid").where(F.col("n") >= F.col("rows") * share).drop("rows")


def sketch_join_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_pid, right_pid, join_size): never below the true size; pairs without a row have size 0."""
    a = left.select(F.col("pid").alias("left_pid"), "depth", "cell", F.col("n").alias("ln"))
    b = right.select(F.col("pid").alias("right_pid"), "depth", "cell", F.col("n").alias("rn"))
    by_depth = a.join(b, ["depth", "cell"]).groupBy("left_pid", "right_pid", "depth").agg(F.sum(F.col("ln") * F.col("rn")).alias("size"))
    depth = left.agg(F.count_distinct("depth").alias("d"))
    least = by_depth.groupBy("left_pid", "right_pid").agg(F.min("size").alias("size"), F.count("*").alias("met"))
    return least.join(F.broadcast(depth)).where("met = d").select("left_pid", "right_pid", F.col("size").alias("join_size"))  # depth is one row


def exact_join_size(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """The same, exact; keys are counted before they meet."""
    a = left.groupBy(F.col("pid").alias("left_pid"), F.col(left_key).alias("k")).agg(F.count("*").alias("ln"))
    b = right.groupBy(F.col("pid").alias("right_pid"), F.col(right_key).alias("k")).agg(F.count("*").alias("rn"))
    return a.join(b, "k").groupBy("left_pid", "right_pid").agg(F.sum(F.col("ln") * F.col("rn")).alias("join_size"))


def store_statistics(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], root: str, width: int = 4096) -> None:
    """Writes each table's statistics and sketches to ``root``/<table>/<column>; a rerun replaces them."""
    for name, df in tables.items():
        for column in columns.get(name, ()):
            partition_statistics(df, column).write.mode("overwrite").parquet(f"{root}/{name}/{column}/statistics")
            count_min(df, column, width).write.mode("overwrite").partitionBy("pid").parquet(f"{root}/{name}/{column}/sketch")


def load_statistics(spark: SparkSession, root: str, name: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{column}/statistics")


def load_sketch(spark: SparkSession, root: str, name: str, column: str) -> DataFrame:
    """One table's sketches; those of a partition are files of their own."""
    return spark.read.schema("depth int, cell long, n long, pid int").parquet(f"{root}/{name}/{column}/sketch")
