"""Aggregate queries as data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JoinEdge:
    """An inner equi-join of a table with one that stands before it."""

    left: str
    right: str
    left_key: str
    right_key: str


@dataclass(frozen=True)
class Agg:
    """``func`` is sum, avg or count; ``expr`` is SQL text, ``*`` for count(*)."""

    func: str
    expr: str
    alias: str

    def __post_init__(self):
        if self.func not in ("sum", "avg", "count"):
            raise ValueError(f"no estimate for {self.func}")


@dataclass(frozen=True)
class AggQuery:
    tables: tuple[str, ...]
    aggs: tuple[Agg, ...]
    joins: tuple[JoinEdge, ...] = ()
    where: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class Params:
    error_tol: float = 2.0
    b: int = 100
    alpha: float = 0.05
    share: float = 0.1
    max_iterations: int | None = None
    mode: str = "cluster"
    seed: int = 2


def joined(query: AggQuery, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The join of the query's tables in order, before filters."""
    out = tables[query.tables[0]]
    for e in query.joins:
        out = out.join(tables[e.right], F.col(e.left_key) == F.col(e.right_key))
    return out


def filtered(query: AggQuery, df: DataFrame) -> DataFrame:
    return reduce(lambda d, w: d.where(w), query.where, df)


def exact(query: AggQuery, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The query's exact answer; sums as doubles of exact decimals."""
    columns = []
    for a in query.aggs:
        total = F.count("*") if a.expr == "*" else F.count(F.expr(a.expr)) if a.func == "count" else F.sum(F.expr(a.expr)).cast("double")
        if a.func == "avg":
            total = total / F.count(F.expr(a.expr))
        columns.append(total.alias(a.alias))
    return filtered(query, joined(query, tables)).groupBy(*query.groups).agg(*columns)
