"""The progressive loops: partitions or paths one after another, an estimate after each.

Only partial aggregates are kept between steps, a few rows for each group and cheap to merge; rows read are not read
again. Over tables that were laid out by partition a step reads the directories it has drawn and no others. A loop
stops when every group's error is below the tolerance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sid import assign_sid, combine_sid
from tidemark.operators import estimator, joingraph, statistics
from tidemark.operators.samplers import draws
from tidemark.plans import sqlfront
from tidemark.plans.spec import AggQuery, Params, filtered, joined
from tidemark.sources.tables import row_key

#: Steps of a loop where the parameters name none.
SINGLE_STEPS, MULTI_STEPS = 3, 5


@dataclass(frozen=True)
class StepResult:
    step: int
    read: tuple
    scale: float
    mode: str
    estimates: DataFrame


def small_enough(estimates: DataFrame, tolerance: float) -> bool:
    row = estimates.agg(F.count("*").alias("n"), F.sum(F.when(F.col("error").isNull() | (F.abs("error") >= tolerance), 1).otherwise(0)).alias("open")).first()
    return bool(row["n"]) and not row["open"]


def _kept(parts: DataFrame) -> DataFrame:
    """Materialises a partial: a few rows for each group and partition, from which later steps start."""
    spark = parts.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return parts.checkpoint()
    return parts.persist()


def single(query: AggQuery, table: DataFrame, name: str, partitions: Sequence[int], params: Params = Params(), order: Sequence[int] | None = None, keep: Callable[[DataFrame], DataFrame] = _kept) -> Iterator[StepResult]:
    """One table with a column ``pid``. ``order`` fixes the partitions drawn."""
    drawn = list(order) if order is not None else list(draws({p: 1.0 for p in partitions}, params.seed))
    by, parts = ("pid" if params.mode == "cluster" else "sid"), []
    sids = table.withColumn("sid", assign_sid(row_key(name), params.b, params.share))
    sizes: list[DataFrame] = []
    for i, pid in enumerate(drawn[: params.max_iterations or SINGLE_STEPS]):
        rows = sids.where(F.col("pid") == pid)
        parts.append(keep(estimator.partials(filtered(query, rows), query, by)))
        merged, scale = estimator.merge_partials(parts, query, by), len(partitions) / (i + 1)
        if params.mode == "cluster":
            out = estimator.cluster(merged, query, i + 1, len(partitions), 2 * params.alpha)
        elif params.mode == "corrected":
            sizes.append(rows.groupBy("sid").agg(F.count("*").alias("m")))
            read = sizes[0]
            for s in sizes[1:]:
                read = read.unionByName(s)
            out = estimator.corrected(merged, query, read.groupBy("sid").agg(F.sum("m").alias("m")), scale, params.alpha, params.b, complete=i + 1 == len(partitions))
        else:
            out = estimator.reference(merged, query, scale, params.alpha)
        yield StepResult(i + 1, tuple(drawn[: i + 1]), scale, params.mode, out)
        if params.error_tol > 0 and small_enough(out, params.error_tol):
            return


def with_join_sid(query: AggQuery, tables: Mapping[str, DataFrame], params: Params = Params(), mode: str = "corrected") -> DataFrame:
    """The join of tables that carry a subsample id each, with the combined ``sid``."""
    marked = {t: tables[t].withColumn(f"{t}_sid", assign_sid(row_key(t), params.b, params.share)) for t in query.tables}
    out = joined(query, marked)
    return out.withColumn("sid", combine_sid([F.col(f"{t}_sid") for t in query.tables], params.b, mode)).drop(*(f"{t}_sid" for t in query.tables))


def path_join(query: AggQuery, tables: Mapping[str, DataFrame], path: Sequence[int]) -> dict[str, DataFrame]:
    """The tables restricted to a path's partitions, before they are joined."""
    return {t: tables[t].where(F.col("pid") == p).drop("pid") for t, p in zip(query.tables, path, strict=True)}


def multi(query: AggQuery, tables: Mapping[str, DataFrame], order: Sequence[Sequence[int]], live: int, params: Params = Params(mode="reference"), keep: Callable[[DataFrame], DataFrame] = _kept) -> Iterator[StepResult]:
    """Several tables, a path of partitions a step; ``live`` is the number of paths that join something.

    ``reference`` does not scale; ``corrected`` scales by live paths over paths read.
    """
    parts, sizes = [], []
    for i, path in enumerate(list(order)[: params.max_iterations or MULTI_STEPS]):
        rows = with_join_sid(query, path_join(query, tables, path), params, params.mode)
        parts.append(keep(estimator.partials(filtered(query, rows), query)))
        merged = estimator.merge_partials(parts, query)
        if params.mode == "corrected":
            sizes.append(rows.groupBy("sid").agg(F.count("*").alias("m")))
            read = sizes[0]
            for s in sizes[1:]:
                read = read.unionByName(s)
            scale = live / (i + 1)
            out = estimator.corrected(merged, query, read.groupBy("sid").agg(F.sum("m").alias("m")), scale, params.alpha, params.b, complete=i + 1 == live)
        else:
            scale, out = 1.0, estimator.reference(merged, query, 1.0, params.alpha)
        yield StepResult(i + 1, tuple(map(tuple, order[: i + 1])), scale, params.mode, out)
        if params.error_tol > 0 and small_enough(out, params.error_tol):
            return


def hop_sizes(query: AggQuery, tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """(left_pid, right_pid, join_size) for consecutive tables of a chain of joins, exact."""
    return [statistics.exact_join_size(tables[e.left], e.left_key, tables[e.right], e.right_key) for e in chain(query)]


def chain(query: AggQuery) -> tuple:
    """The joins of a query whose tables hang together one after another."""
    for e, left, right in zip(query.joins, query.tables, query.tables[1:], strict=False):
        if (e.left, e.right) != (left, right):
            raise ValueError(f"{e.right} is not joined to {left}: paths need a chain of joins")
    return query.joins


def weighted_paths(query: AggQuery, tables: Mapping[str, DataFrame], weights: str = "size", sizes: Sequence[DataFrame] | None = None) -> DataFrame:
    """Live paths with their ``weight``: ``uniform``, ``size``, ``groups`` or ``zscore``. ``sizes``: stored join sizes of the hops."""
    sizes = list(sizes) if sizes is not None else hop_sizes(query, tables)
    live = joingraph.paths_of_sizes(sizes)
    if weights == "uniform":
        return live.withColumn("weight", F.lit(1.0))
    if weights == "zscore":
        keys = [query.joins[0].left_key, *(e.right_key for e in query.joins)]
        return joingraph.weight_by_zscore(live, [statistics.partition_statistics(tables[t], k) for t, k in zip(query.tables, keys, strict=True)])
    middle = next((t for t in query.tables if any(g in tables[t].columns for g in query.groups)), query.tables[0])
    own = [F.col(g) for g in query.groups if g in tables[middle].columns] or [F.lit(1)]
    groups = tables[middle].groupBy("pid").agg(F.count_distinct(F.struct(*own)).alias("count_unique"))
    at = query.tables.index(middle)
    out = joingraph.weight_by_groups(live, groups, at) if weights == "groups" else joingraph.weight_by_size(live, len(sizes), groups, at)
    return out.withColumn("weight", F.greatest("weight", F.lit(1e-6)))  # the least of normalised weights is 0, but a live path has a chance


def multi_weighted(query: AggQuery, tables: Mapping[str, DataFrame], params: Params = Params(mode="corrected"), weights: str = "size", sizes: Sequence[DataFrame] | None = None) -> Iterator[StepResult]:
    """Several tables; paths are drawn by weight without replacement. Only the paths drawn come to the driver."""
    paths = weighted_paths(query, tables, weights, sizes).persist()
    live = paths.count()
    drawn = joingraph.draw_paths(paths, params.max_iterations or MULTI_STEPS, params.seed).collect()
    paths.unpersist()
    yield from multi(query, tables, [tuple(r)[:-1] for r in drawn], live, params)


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], partitions: Sequence[int], params: Params | None = None, weights: str = "size") -> Iterator[StepResult]:
    """A query text to its loop: over partitions for one table, over paths for several. Tables carry ``pid``."""
    query = sqlfront.parse(spark, sql, {n: df.columns for n, df in tables.items()})
    if len(query.tables) == 1:
        name = query.tables[0]
        return single(query, tables[name], name, partitions, params or Params())
    return multi_weighted(query, tables, params or Params(mode="corrected"), weights)


def all_steps(steps: Iterator[StepResult]) -> DataFrame:
    """The history of a run: the estimates of each step with its number."""
    out = None
    for s in steps:
        rows = s.estimates.withColumn("step", F.lit(s.step))
        out = rows if out is None else out.unionByName(rows)
    return out
