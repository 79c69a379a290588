"""Estimates against exact answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def true_error(exact: DataFrame, value: str, estimates: DataFrame, agg: str, groups: Sequence[str]) -> DataFrame:
    """(n_groups, mean_error): the mean over groups of |estimate - truth| / |truth|; 1 if no group was found."""
    mine = estimates.where(F.col("agg") == agg).select(*groups, "est")
    both = exact.join(mine, list(groups)) if groups else exact.join(F.broadcast(mine))  # one row
    error = F.abs(F.col("est") - F.col(value)) / F.abs(F.col(value))
    return both.agg(F.count("*").alias("n_groups"), F.coalesce(F.avg(error), F.lit(1.0)).alias("mean_error"))


def coverage(read: DataFrame, tables: Sequence[int]) -> DataFrame:
    """(share): distinct partitions of all tables that the paths (p0, p1, ...) touch, over all partitions."""
    touched = sum((F.count_distinct(f"p{k}") for k in range(1, len(tables))), F.count_distinct("p0"))
    return read.agg((touched / F.lit(float(sum(tables)))).alias("share"))
