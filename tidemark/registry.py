"""All registered queries over the reference tables, and the SQL that restates them.

Everything drawn derives from MD5 of a row's key, so SQL can restate samples, subsample ids and orders; sums are
taken over decimals, so that they do not depend on the order of rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import crc32_unit, java_hash, md5_unit, mult_unit
from tidemark.functions.sid import assign_sid
from tidemark.operators import accuracy, estimator, joingraph, samplers, statistics
from tidemark.plans import benchmark as bench
from tidemark.plans.progressive import all_steps, multi, path_join, single, weighted_paths, with_join_sid
from tidemark.plans.spec import Params, exact, filtered, joined
from tidemark.sources.tables import PARTITIONS, lay_out, load_table, load_views, partition_manifest, partitions_in_range, row_key, with_partition

Query = Callable[[SparkSession, str], DataFrame]
_DRAWN = (3, 1, 4)
_PATHS = ((3, 3), (1, 1), (4, 4), (0, 0), (6, 6))
_B = 100


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return with_partition(load_table(spark, d, name), name)


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: _table(spark, d, n) for n in names}


_laid: dict[tuple[str, str, str], str] = {}


def _parted(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """Tables laid out by partition, once for each application, in the folder that driver and executors share."""
    out = {}
    for n in names:
        at = (spark.sparkContext.applicationId, d, n)
        if at not in _laid:
            base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if not base:
                alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
                base = tempfile.mkdtemp(prefix="tidemark-") if alone else spark.conf.get("spark.sql.warehouse.dir")
            _laid[at] = f"{base}/parted-{uuid.uuid4().hex}"
            lay_out(_table(spark, d, n), _laid[at])
        out[n] = spark.read.schema(_table(spark, d, n).schema).parquet(_laid[at])
    return out


# ---- SQL: typed tables with row key, partition and subsample id ----


def _unit(key: str, part: int = 0) -> str:
    return f"(('0x' || substr(md5({key}), {1 + 8 * part}, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _sid(key: str) -> str:
    return f"CASE WHEN {_unit(key)} < 0.1::DOUBLE THEN CAST(floor({_unit(f"{key} || '|sid'")} * {_B}) + 1 AS INTEGER) ELSE 0 END"


_KEYS = {"lineitem": "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)", "orders": "CAST(o_orderkey AS VARCHAR)", "customer": "CAST(c_custkey AS VARCHAR)", "part": "CAST(p_partkey AS VARCHAR)"}
_FIRST = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}
_DECIMALS = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "orders": ("o_totalprice",), "customer": ("c_acctbal",), "part": ("p_retailprice",)}
_DATES = {"lineitem": ("l_shipdate",), "orders": ("o_orderdate",)}


def _cte(*names: str, body: str) -> str:
    """Typed views x_<name> before a query body."""
    views = []
    for n in names:
        if n == "partsupp":
            views.append("x_partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)")
            continue
        swaps = [f"CAST({c} AS DECIMAL(12,2)) AS {c}" for c in _DECIMALS.get(n, ())] + [f"CAST({c} AS DATE) AS {c}" for c in _DATES.get(n, ())]
        replace = f" REPLACE ({', '.join(swaps)})" if swaps else ""
        views.append(f"x_{n} AS (SELECT *{replace}, {_KEYS[n]} AS k, CAST({_FIRST[n]} % {PARTITIONS} AS INTEGER) AS pid, {_sid(_KEYS[n])} AS sid FROM {n})")
    return f"WITH {', '.join(views)} {body}"


def _join_sid(k: int) -> str:
    """Combined id of k tables a, b, ...: digits of base 10."""
    sids = [f"{'abcd'[i]}.sid" for i in range(k)]
    zero = " OR ".join(f"{s} = 0" for s in sids)
    digits = " + ".join(f"(({s} - 1) // 10) * {10 ** (k - 1 - i)}" for i, s in enumerate(sids))
    return f"CASE WHEN {zero} THEN 0 ELSE CAST(({digits}) // {10 ** (k - 2)} + 1 AS INTEGER) END"


_REVENUE = "l_extendedprice * (1 - l_discount)"
_OI = "x_orders a JOIN x_lineitem b ON o_orderkey = l_orderkey"
_COI = "x_customer a JOIN x_orders b ON c_custkey = o_custkey JOIN x_lineitem c ON o_orderkey = l_orderkey"
_PI = "x_part JOIN x_partsupp ON p_partkey = ps_partkey JOIN x_lineitem ON ps_partkey = l_partkey"
_EARLY = "o_orderdate < DATE '1995-03-15'"
_SUM = f"CAST(sum({_REVENUE}) AS DOUBLE)"
_AVG = f"CAST(sum({_REVENUE}) AS DOUBLE) / count({_REVENUE})"

_Q1_AGGS = (("sum", "l_quantity", "sum_qty"), ("avg", "l_extendedprice", "avg_price"), ("avg", "l_discount", "avg_disc"), ("count", "1", "count_order"))
_Q1_PARTIAL = "SELECT l_returnflag, l_linestatus, sid, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(l_extendedprice) AS DOUBLE) / count(l_extendedprice) AS avg_price, CAST(sum(l_discount) AS DOUBLE) / count(l_discount) AS avg_disc, CAST(count(*) AS DOUBLE) AS count_order FROM {rows} GROUP BY ALL"


def _partial(func: str, expr: str) -> str:
    return {"sum": f"CAST(sum({expr}) AS DOUBLE)", "count": f"CAST(count({expr}) AS DOUBLE)", "avg": f"CAST(sum({expr}) AS DOUBLE) / count({expr})"}[func]


def _reference_sql(rows: str, groups: str, aggs, sf: float = 1.0) -> str:
    """Estimates of the reference mode over ``rows`` that carry sid."""
    parts = []
    for func, expr, alias in aggs:
        g = f"{groups}, " if groups else ""
        total = f"CAST(sum(CAST({_partial('avg', expr)} AS DECIMAL(28,6))) OVER w AS DOUBLE) / count(*) OVER w" if func == "avg" else f"CAST(sum({'sum' if func == 'sum' else 'count'}({expr})) OVER w AS DOUBLE) * {sf}::DOUBLE"
        parts.append(f"""
SELECT '{alias}' AS agg, {g}est, est - quantile_disc(d, 0.95) * sqrt(sqrt(n) / n) AS ci_low, est - quantile_disc(d, 0.05) * sqrt(sqrt(n) / n) AS ci_high
FROM (SELECT {g}est, n, CASE WHEN sid > 0 THEN x - est END AS d
      FROM (SELECT {g}sid, {_partial(func, expr)} AS x, {total} AS est, CAST(count(*) OVER () AS DOUBLE) AS n
            FROM {rows} GROUP BY {g}sid WINDOW w AS (PARTITION BY {groups or '1'})))
GROUP BY {g}est, n""")
    return f"SELECT *, CASE WHEN (ci_high + ci_low) / 2 <> 0 THEN (ci_high - ci_low) / 2 / ((ci_high + ci_low) / 2) * 100 END AS error FROM ({' UNION ALL '.join(parts)})"


def _corrected_sql(rows: str, groups: str, aggs, sf: float) -> str:
    parts = []
    for func, expr, alias in aggs:
        s = f"sum({expr})" if func != "count" else f"count({expr})"
        if func == "avg":
            inner = f"""
SELECT {groups}, est, sqrt(CAST(c AS DOUBLE)) * (CAST(s AS DOUBLE) / c - est) AS d, n FROM (
  SELECT *, CAST(sum(s) OVER w AS DOUBLE) / sum(c) OVER w AS est, CAST(sum(c) OVER w AS DOUBLE) AS n
  FROM (SELECT {groups}, sid, {s} AS s, count({expr}) AS c FROM {rows} GROUP BY {groups}, sid) WINDOW w AS (PARTITION BY {groups})) WHERE sid > 0"""
        else:
            on = " AND ".join(f"g.{c.strip()} = p.{c.strip()}" for c in groups.split(","))
            named = ", ".join(f"g.{c.strip()}" for c in groups.split(","))
            inner = f"""
SELECT {named}, est, sqrt(m) * (coalesce(CAST(p.s AS DOUBLE), 0) * (n / m) * {sf}::DOUBLE - est) AS d, n
FROM (SELECT {groups}, CAST({s} AS DOUBLE) * {sf}::DOUBLE AS est FROM {rows} GROUP BY {groups}) g
CROSS JOIN (SELECT sid, CAST(count(*) AS DOUBLE) AS m, CAST(sum(count(*)) OVER () AS DOUBLE) AS n FROM {rows} GROUP BY sid) z
LEFT JOIN (SELECT {groups}, sid, {s} AS s FROM {rows} GROUP BY {groups}, sid) p ON {on} AND p.sid = z.sid
WHERE z.sid > 0"""
        parts.append(f"SELECT '{alias}' AS agg, {groups}, est, est - quantile_disc(d, 0.975) / sqrt(n) AS ci_low, est - quantile_disc(d, 0.025) / sqrt(n) AS ci_high FROM ({inner}) GROUP BY {groups}, est, n")
    return f"SELECT *, CASE WHEN (ci_high + ci_low) / 2 <> 0 THEN (ci_high - ci_low) / 2 / ((ci_high + ci_low) / 2) * 100 END AS error FROM ({' UNION ALL '.join(parts)})"


def _cluster_sql(k: int) -> str:
    """Q1's sum and count at step k of the fixed order, to two places."""
    t, fpc = estimator.t_quantile(0.95, k - 1), (1 - k / PARTITIONS) ** 0.5
    parts = []
    for func, expr, alias in _Q1_AGGS:
        s = f"CAST({'count' if func == 'count' else 'sum'}({expr}) AS DOUBLE)"
        est = "sum(t) OVER w / sum(c) OVER w" if func == "avg" else f"{PARTITIONS} * (sum(t) OVER w / {k})"
        r = "t - est * c" if func == "avg" else "t"
        scale = f"(1 / (sum(c) / {k}))" if func == "avg" else f"{PARTITIONS}.0::DOUBLE"
        parts.append(f"""
SELECT '{alias}' AS agg, l_returnflag, l_linestatus, est,
       {t!r}::DOUBLE * {scale} * {fpc!r}::DOUBLE * sqrt(greatest(0, (sum(({r}) * ({r})) - sum({r}) * sum({r}) / {k}) / {k - 1})) / sqrt({k}::DOUBLE) AS width
FROM (SELECT *, {est} AS est FROM (SELECT l_returnflag, l_linestatus, pid, {s} AS t, CAST(count(*) AS DOUBLE) AS c
      FROM x_lineitem WHERE pid IN ({', '.join(map(str, _DRAWN[:k]))}) GROUP BY ALL) WINDOW w AS (PARTITION BY l_returnflag, l_linestatus))
GROUP BY l_returnflag, l_linestatus, est""")
    return f"SELECT agg, l_returnflag, l_linestatus, round(est, 2) AS est, round(est - width, 2) AS ci_low, round(est + width, 2) AS ci_high, {k} AS step FROM ({' UNION ALL '.join(parts)})"


def _hops() -> str:
    return """s0 AS (SELECT a.pid AS p0, b.pid AS p1, count(*) AS s0 FROM x_customer a JOIN x_orders b ON c_custkey = o_custkey GROUP BY ALL),
s1 AS (SELECT a.pid AS p1, b.pid AS p2, count(*) AS s1 FROM x_orders a JOIN x_lineitem b ON o_orderkey = l_orderkey GROUP BY ALL),
parts AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS p),
paths AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2 FROM parts a, parts b, parts c),
sized AS (SELECT p0, p1, p2, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1 FROM paths LEFT JOIN s0 USING (p0, p1) LEFT JOIN s1 USING (p1, p2))"""


def _path_cte(body: str) -> str:
    return _cte("customer", "orders", "lineitem", body="") + ", " + _hops() + " " + body


def _stat_sql(column: str) -> str:
    h = f"('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8))::UBIGINT::HUGEINT"
    return f"SELECT pid, CAST(sum({h}) AS DOUBLE) / count(*) / 4294967296.0::DOUBLE AS mean, CAST(sum({h} * {h}) AS DOUBLE) / count(*) / 4294967296.0::DOUBLE / 4294967296.0::DOUBLE AS q, count(*) AS n, count(DISTINCT {column}) AS u"


# ---- queries ----


def _chain(spark: SparkSession, d: str):
    t = _tables(spark, d, "customer", "orders", "lineitem")
    hops = [joingraph.edges(t["customer"], t["orders"]), joingraph.edges(t["orders"], t["lineitem"])]
    sizes = [statistics.exact_join_size(t["customer"], "c_custkey", t["orders"], "o_custkey"), statistics.exact_join_size(t["orders"], "o_orderkey", t["lineitem"], "l_orderkey")]
    return t, joingraph.paths(hops), sizes


def _sized(spark: SparkSession, d: str) -> DataFrame:
    _, paths, sizes = _chain(spark, d)
    return joingraph.with_hop_sizes(paths, sizes)


def _path_weight(spark: SparkSession, d: str) -> DataFrame:
    t, paths, sizes = _chain(spark, d)
    groups = t["orders"].groupBy("pid").agg(F.count_distinct("o_orderdate").alias("count_unique"))
    return joingraph.weight_by_size(joingraph.with_hop_sizes(paths, sizes), 2, groups).select("p0", "p1", "p2", F.round("weight", 6).alias("weight"))


def _zscore(spark: SparkSession, d: str) -> DataFrame:
    t, paths, _ = _chain(spark, d)
    stats = [statistics.partition_statistics(t["customer"], "c_custkey"), statistics.partition_statistics(t["orders"], "o_custkey"), statistics.partition_statistics(t["lineitem"], "l_orderkey")]
    return joingraph.weight_by_zscore(paths, stats).select("p0", "p1", "p2", F.round("z", 6).alias("z"), F.round("weight", 6).alias("weight"))


def _read_paths(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.col("id").cast("int").alias("p0"), F.col("id").cast("int").alias("p1"), F.col("id").cast("int").alias("p2"))


def _q1_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem")
    return rows.withColumn("sid", assign_sid(row_key("lineitem"), _B))


def _q2_rows(spark: SparkSession, d: str) -> DataFrame:
    t = {n: df.drop("pid") for n, df in _tables(spark, d, "orders", "lineitem").items()}
    return with_join_sid(bench.Q2, t, Params(b=_B))


def _q1_partial(df: DataFrame) -> DataFrame:
    p = estimator.partials(df, bench.Q1)
    return p.select(*bench.Q1.groups, "sid", *(estimator._value(a).alias(a.alias) for a in bench.Q1.aggs))


def _stat(column: str) -> Query:
    return lambda s, d: statistics.partition_statistics(_table(s, d, "orders"), "o_custkey").select("pid", F.round(column, 6).alias(column) if column != "count_unique" else F.col(column))


def _hashed(name: str, unit, kind: str) -> Query:
    return lambda s, d: load_table(s, d, "orders").select("o_orderkey", unit(F.col("o_orderkey")).cast(kind).alias(name))


def _sql(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        load_views(spark, d)
        return spark.sql(text)

    return run


def _cluster(spark: SparkSession, d: str) -> DataFrame:
    steps = single(bench.Q1, _parted(spark, d, "lineitem")["lineitem"], "lineitem", range(PARTITIONS), Params(error_tol=0), _DRAWN)
    next(steps)  # one partition has no interval
    out = all_steps(steps)
    return out.select("agg", *bench.Q1.groups, *(F.round(c, 2).alias(c) for c in ("est", "ci_low", "ci_high")), "step")


def _progressive_join(spark: SparkSession, d: str) -> DataFrame:
    t = _parted(spark, d, "orders", "lineitem")
    return all_steps(multi(bench.Q2, t, _PATHS, PARTITIONS, Params(error_tol=0, b=_B, mode="reference")))


def _true_error(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "lineitem")
    *_, last = single(bench.Q1, _parted(spark, d, "lineitem")["lineitem"], "lineitem", range(PARTITIONS), Params(error_tol=0), _DRAWN)
    found = accuracy.true_error(exact(bench.Q1, t), "sum_qty", last.estimates, "sum_qty", bench.Q1.groups)
    return found.select("n_groups", F.round("mean_error", 6).alias("mean_error"))


def _path_rows(spark: SparkSession, d: str, path: tuple[int, int]) -> DataFrame:
    return joined(bench.Q2, path_join(bench.Q2, _parted(spark, d, "orders", "lineitem"), path)).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    """Partitions that hold the rows which the first three paths of a run have read, over all partitions."""
    t = _parted(spark, d, "orders", "lineitem")
    *_, last = multi(bench.Q2, t, _PATHS, PARTITIONS, Params(error_tol=0, b=_B, mode="reference", max_iterations=3))
    drawn = lambda k, n: t[n].where(F.col("pid").isin(sorted({p[k] for p in last.read}))).select(F.col("pid").alias(f"p{k}")).distinct()
    read = [drawn(k, n) for k, n in enumerate(bench.Q2.tables)]
    both = read[0].unionByName(read[1], allowMissingColumns=True)
    return accuracy.coverage(both, [PARTITIONS] * 2)


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    """Partitions 3 and 1 are read; of 1 and 4 only 4 is added."""
    rows = _table(spark, d, "orders")
    cached = rows.where(F.col("pid").isin(3, 1))
    wanted = rows.where(F.col("pid").isin(1, 4))
    return cached.unionByName(wanted.join(cached.select("pid").distinct(), "pid", "left_anti")).select("o_orderkey", "pid")


def queries() -> dict[str, Query]:
    text = lambda df: df.withColumn("o_orderdate", F.col("o_orderdate").cast("string")) if "o_orderdate" in df.columns else df
    q: dict[str, Query] = {f"exact_{k}": (lambda s, d, v=v: text(exact(v, {n: load_table(s, d, n) for n in v.tables}))) for k, v in bench.ALL.items()}
    li, od = (lambda s, d: _table(s, d, "lineitem")), (lambda s, d: _table(s, d, "orders"))
    key = "o_orderkey"
    return q | {
        "scan_tables": lambda s, d: load_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_shipdate").cast("string").alias("l_shipdate")),
        "partition_scan": lambda s, d: _parted(s, d, "orders")["orders"].where("pid = 3").select("o_orderkey", "o_orderstatus"),
        "partition_manifest": lambda s, d: partition_manifest(od(s, d), "o_orderkey"),
        "partition_prune": lambda s, d: partitions_in_range(partition_manifest(load_table(s, d, "orders").withColumn("pid", F.floor(F.col("o_orderkey") / 2000).cast("int")), "o_orderkey"), 2500, 6100),
        "exact_q5": _sql(bench.Q5_SQL),
        "exact_q5_temp": lambda s, d: joined(bench.Q5_AVG, {n: load_table(s, d, n) for n in bench.Q5_AVG.tables}).select(F.col("l_extendedprice").cast("double").alias("avg_yearly"), "p_brand"),
        "exact_q8": lambda s, d: joined(bench.Q6, {n: load_table(s, d, n) for n in bench.Q6.tables}).select(F.expr(bench.REVENUE).cast("double").alias("sum_revenue"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("string").alias("o_orderdate")),
        "project_revenue": lambda s, d: load_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(bench.REVENUE).cast("double").alias("revenue")),
        "sid_single": lambda s, d: _q1_rows(s, d).groupBy("sid").agg(F.count("*").alias("n")),
        "sid_join": lambda s, d: _q2_rows(s, d).groupBy("sid").agg(F.count("*").alias("n")),
        "sid_join3": lambda s, d: with_join_sid(bench.Q6, {n: load_table(s, d, n) for n in bench.Q6.tables}, Params(b=_B)).groupBy("sid").agg(F.count("*").alias("n")),
        "partial_by_sid": lambda s, d: _q1_partial(_q1_rows(s, d)),
        "partial_by_sid_join": lambda s, d: estimator.partials(_q2_rows(s, d), bench.Q2).select(*bench.Q2.groups, "sid", F.col("sum_revenue__s").cast("double").alias("sum_revenue")),
        "path_join": lambda s, d: _path_rows(s, d, (3, 3)),
        "join_graph_edges": lambda s, d: joingraph.edges(od(s, d), li(s, d)),
        "join_paths": lambda s, d: _chain(s, d)[1],
        "join_paths_new": lambda s, d: joingraph.new_paths(_chain(s, d)[1], _read_paths(s)),
        "cms_build": lambda s, d: statistics.count_min(od(s, d), "o_custkey", 4096),
        "cms_join_size": lambda s, d: statistics.sketch_join_size(statistics.count_min(_table(s, d, "customer"), "c_custkey", 4096), statistics.count_min(od(s, d), "o_custkey", 4096)),
        "exact_join_size": lambda s, d: _chain(s, d)[2][0].select("left_pid", "right_pid", F.col("join_size").cast("long").alias("join_size")),
        "stat_mean": _stat("mean"),
        "stat_std_error": _stat("std_error"),
        "stat_count_unique": _stat("count_unique"),
        "estimate_single": lambda s, d: estimator.reference(estimator.partials(_q1_rows(s, d), bench.Q1), bench.Q1),
        "estimate_join": lambda s, d: estimator.reference(estimator.partials(_q2_rows(s, d), bench.Q2), bench.Q2),
        "estimate_corrected": lambda s, d: estimator.corrected(estimator.partials(_q1_rows(s, d).where("pid = 3"), bench.Q1), bench.Q1, _q1_rows(s, d).where("pid = 3").groupBy("sid").agg(F.count("*").alias("m")), float(PARTITIONS)),
        "conf_bounds": lambda s, d: estimator.reference(estimator.partials(filtered(bench.Q4, _q1_rows(s, d)), bench.Q4), bench.Q4, 1.0).select("est", "ci_low", "ci_high"),
        "quantile_disc": lambda s, d: load_table(s, d, "lineitem").groupBy("l_returnflag").agg(*(estimator.quantile("cast(l_extendedprice as double)", p).alias(n) for p, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95")))),
        "scale_single": lambda s, d: estimator.reference(estimator.partials(_q1_rows(s, d).where("pid in (3, 1)"), bench.Q1), bench.Q1, PARTITIONS / 2).where("agg = 'count_order'").select("l_returnflag", "l_linestatus", "est"),
        "true_error": _true_error,
        "coverage": _coverage,
        "weighted_order": lambda s, d: samplers.weighted_order(load_table(s, d, "customer").withColumn("w", F.col("c_nationkey").cast("double")), F.col("c_custkey"), "w").select("c_custkey", F.round("draw", 6).alias("draw")),
        "live_paths": lambda s, d: joingraph.live_paths(_sized(s, d), 2),
        "path_weight": _path_weight,
        "path_weight_groups": lambda s, d: joingraph.weight_by_groups(_chain(s, d)[1], od(s, d).groupBy("pid").agg(F.count_distinct("o_orderdate").alias("count_unique"))),
        "path_zscore": _zscore,
        "random_paths": lambda s, d: joingraph.random_paths(_chain(s, d)[1], 20),
        "draw_paths": lambda s, d: joingraph.draw_paths(weighted_paths(bench.Q2, _parted(s, d, "orders", "lineitem"), "uniform"), 5).select("p0", "p1"),
        "rank_paths": lambda s, d: joingraph.rank_paths(_path_weight(s, d), 10),
        "progressive_single": _cluster,
        "progressive_join": _progressive_join,
        "accumulate_partitions": lambda s, d: _parted(s, d, "orders")["orders"].where("pid in (3, 1)").select("o_orderkey", "pid"),
        "accumulate_paths": lambda s, d: _path_rows(s, d, (3, 3)).unionByName(_path_rows(s, d, (1, 1))),
        "accumulate_dedup": _dedup,
        "hash_md5_a": _hashed("h", lambda c: md5_unit(c), "double"),
        "hash_md5_b": _hashed("h", lambda c: md5_unit(c, 1), "double"),
        "hash_java": _hashed("h", java_hash, "long"),
        "hash_mult": _hashed("h", mult_unit, "double"),
        "universe_crc32": lambda s, d: samplers.universe_crc32(load_table(s, d, "orders").withColumn("u", crc32_unit(F.col(key))), F.col(key), 0.1).select(key, "u"),
        "universe_md5": lambda s, d: samplers.universe(load_table(s, d, "orders"), F.col(key), 0.1).select(key),
        "universe_join": lambda s, d: samplers.universe(load_table(s, d, "orders"), F.col(key), 0.1).join(samplers.universe(load_table(s, d, "lineitem"), F.col("l_orderkey"), 0.1), F.col(key) == F.col("l_orderkey")).groupBy("l_linestatus").agg(F.count("*").alias("n")),
        "uniform_groups": lambda s, d: samplers.with_group(load_table(s, d, "orders"), F.col(key), 10).select(key, "grp"),
        "range_sample": lambda s, d: samplers.hash_range(load_table(s, d, "orders"), F.col(key), 20, 35).select(key),
        "stratified": lambda s, d: samplers.stratified(load_table(s, d, "orders"), "o_orderpriority", 0.1).select(key),
        "stratified_hash": lambda s, d: samplers.stratified_hash(load_table(s, d, "orders"), "o_orderpriority", F.col(key), 0.1).select(key, "o_orderpriority"),
        "bernoulli": lambda s, d: samplers.bernoulli(load_table(s, d, "orders"), 0.1).select(key),
        "bernoulli_hash": lambda s, d: samplers.bernoulli_hash(load_table(s, d, "orders"), F.col(key), 0.1).select(key),
    }


def oracle_sql() -> dict[str, str]:
    o = "CAST(o_orderkey AS VARCHAR)"
    java = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({o}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296)"
    signed = f"CASE WHEN {java} >= 2147483648 THEN {java} - 4294967296 ELSE {java} END"
    groups = "(SELECT pid AS p1, CAST(count(DISTINCT o_orderdate) AS DOUBLE) AS g FROM x_orders GROUP BY 1)"
    weight = f"""SELECT p0, p1, p2, round(CASE WHEN size > 0 AND g > 0 THEN 0.5 * (CASE WHEN max(size) OVER () > min(size) OVER () THEN (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) ELSE 0 END)
      + 0.5 * (CASE WHEN max(g) OVER () > min(g) OVER () THEN (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) ELSE 0 END) ELSE 0 END, 6) AS weight
      FROM (SELECT p0, p1, p2, CASE WHEN s0 > 0 THEN s0::DOUBLE ELSE 1 END * CASE WHEN s1 > 0 THEN s1::DOUBLE ELSE 1 END AS size, g FROM sized JOIN {groups} USING (p1))"""
    stat = f"{_stat_sql('o_custkey')} FROM x_orders GROUP BY pid"
    se = "sqrt(greatest(0, q - mean * mean)) / sqrt(n)"
    st = lambda c, t, i: f"(SELECT pid AS p{i}, mean AS m{i}, {se} AS e{i} FROM ({_stat_sql(c)} FROM {t} GROUP BY pid))"
    oi_rows = f"(SELECT *, {_join_sid(2)} AS jsid FROM {_OI})"
    q2 = f"(SELECT l_linestatus, o_orderpriority, l_extendedprice, l_discount, jsid AS sid FROM {oi_rows})"
    q2_agg = (("sum", _REVENUE, "sum_revenue"),)
    item = "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus FROM"
    word = lambda c, part: f"('0x' || substr(md5(CAST({c} AS VARCHAR)), {1 + 8 * part}, 8))::UBIGINT::BIGINT"
    cells = lambda c, t: f"SELECT pid, CAST(depth AS INTEGER) AS depth, ({word(c, 0)} + depth * {word(c, 1)}) % 4096 AS cell FROM {t}, (SELECT unnest(range(5)) AS depth) WHERE {c} IS NOT NULL"
    draw = lambda *ps: f"""-ln(({_unit("'2|' || " + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in ps))} * 4294967296.0::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"""
    join_steps = " UNION ALL ".join(
        f"SELECT *, {k} AS step FROM ({_reference_sql(f'(SELECT l_linestatus, o_orderpriority, l_extendedprice, l_discount, jsid AS sid FROM {oi_rows} WHERE pid IN ({", ".join(str(p[0]) for p in _PATHS[:k])}))', 'l_linestatus, o_orderpriority', q2_agg)})"
        for k in range(1, 6)
    )
    return {
        "scan_tables": _cte("lineitem", body="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM x_lineitem"),
        "partition_scan": _cte("orders", body="SELECT o_orderkey, o_orderstatus FROM x_orders WHERE pid = 3"),
        "partition_manifest": _cte("orders", body="SELECT pid, count(*) AS n_rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM x_orders GROUP BY pid"),
        "partition_prune": "SELECT * FROM (SELECT CAST(o_orderkey // 2000 AS INTEGER) AS pid, count(*) AS n_rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1) WHERE hi >= 2500 AND lo <= 6100",
        "exact_q1": _cte("lineitem", body="SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(l_extendedprice) AS DOUBLE) / count(*) AS avg_price, CAST(sum(l_discount) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order FROM x_lineitem GROUP BY 1, 2"),
        "exact_q2": _cte("orders", "lineitem", body=f"SELECT l_linestatus, o_orderpriority, {_SUM} AS sum_revenue FROM {_OI} GROUP BY 1, 2"),
        "exact_q3": _cte("customer", "orders", "lineitem", body=f"SELECT c_mktsegment, {_SUM} AS sum_revenue FROM {_COI} JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
        "exact_q4": _cte("lineitem", body="SELECT CAST(sum(l_extendedprice * l_discount) AS DOUBLE) AS sum_revenue FROM x_lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
        "exact_q5": _cte("part", "partsupp", "lineitem", body=f"SELECT CAST(sum(l_extendedprice) AS DOUBLE) AS sum_yearly FROM {_PI} WHERE l_quantity < (SELECT 0.2 * avg(i.l_quantity) FROM x_lineitem i WHERE i.l_partkey = p_partkey)"),
        "exact_q5_avg": _cte("part", "partsupp", "lineitem", body=f"SELECT p_brand, CAST(sum(l_extendedprice) AS DOUBLE) / count(*) AS avg_yearly FROM {_PI} GROUP BY 1"),
        "exact_q5_temp": _cte("part", "partsupp", "lineitem", body=f"SELECT CAST(l_extendedprice AS DOUBLE) AS avg_yearly, p_brand FROM {_PI}"),
        "exact_q6": _cte("customer", "orders", "lineitem", body=f"SELECT o_orderpriority, o_orderstatus, {_SUM} AS sum_revenue FROM {_COI} WHERE {_EARLY} GROUP BY 1, 2"),
        "exact_q6_avg": _cte("customer", "orders", "lineitem", body=f"SELECT o_orderpriority, o_orderstatus, {_AVG} AS avg_revenue FROM {_COI} WHERE {_EARLY} GROUP BY 1, 2"),
        "exact_q7": _cte("customer", "orders", "lineitem", body=f"SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate, {_SUM} AS sum_revenue FROM {_COI} WHERE {_EARLY} GROUP BY b.o_orderdate"),
        "exact_q7_avg": _cte("customer", "orders", "lineitem", body=f"SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate, {_AVG} AS avg_revenue FROM {_COI} WHERE {_EARLY} GROUP BY b.o_orderdate"),
        "exact_q8": _cte("customer", "orders", "lineitem", body=f"SELECT CAST({_REVENUE} AS DOUBLE) AS sum_revenue, o_orderstatus, o_orderpriority, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM {_COI}"),
        "project_revenue": _cte("lineitem", body=f"SELECT l_orderkey, l_linenumber, CAST({_REVENUE} AS DOUBLE) AS revenue FROM x_lineitem"),
        "sid_single": _cte("lineitem", body="SELECT sid, count(*) AS n FROM x_lineitem GROUP BY 1"),
        "sid_join": _cte("orders", "lineitem", body=f"SELECT {_join_sid(2)} AS sid, count(*) AS n FROM {_OI} GROUP BY 1"),
        "sid_join3": _cte("customer", "orders", "lineitem", body=f"SELECT {_join_sid(3)} AS sid, count(*) AS n FROM {_COI} GROUP BY 1"),
        "partial_by_sid": _cte("lineitem", body=_Q1_PARTIAL.format(rows="x_lineitem")),
        "partial_by_sid_join": _cte("orders", "lineitem", body=f"SELECT l_linestatus, o_orderpriority, {_join_sid(2)} AS sid, {_SUM} AS sum_revenue FROM {_OI} GROUP BY 1, 2, 3"),
        "path_join": _cte("orders", "lineitem", body=f"{item} {_OI} WHERE a.pid = 3 AND b.pid = 3"),
        "join_graph_edges": _cte("orders", "lineitem", body="SELECT a.pid AS left_pid, b.pid AS right_pid FROM (SELECT DISTINCT pid FROM x_orders) a CROSS JOIN (SELECT DISTINCT pid FROM x_lineitem) b"),
        "join_paths": _path_cte("SELECT * FROM paths"),
        "join_paths_new": _path_cte("SELECT * FROM paths WHERE NOT (p0 = p1 AND p1 = p2 AND p0 < 4)"),
        "exact_join_size": _path_cte("SELECT p0 AS left_pid, p1 AS right_pid, s0 AS join_size FROM s0"),
        "stat_mean": _cte("orders", body=f"SELECT pid, round(mean, 6) AS mean FROM ({stat})"),
        "stat_std_error": _cte("orders", body=f"SELECT pid, round({se}, 6) AS std_error FROM ({stat})"),
        "stat_count_unique": _cte("orders", body=f"SELECT pid, u AS count_unique FROM ({stat})"),
        "estimate_single": _cte("lineitem", body=_reference_sql("x_lineitem", "l_returnflag, l_linestatus", _Q1_AGGS)),
        "estimate_join": _cte("orders", "lineitem", body=_reference_sql(q2, "l_linestatus, o_orderpriority", q2_agg)),
        "estimate_corrected": _cte("lineitem", body=_corrected_sql("(SELECT * FROM x_lineitem WHERE pid = 3)", "l_returnflag, l_linestatus", _Q1_AGGS, float(PARTITIONS))),
        "conf_bounds": _cte("lineitem", body=f"SELECT est, ci_low, ci_high FROM ({_reference_sql('(SELECT * FROM x_lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24)', '', (('sum', 'l_extendedprice * l_discount', 'sum_revenue'),))})"),
        "quantile_disc": _cte("lineitem", body="SELECT l_returnflag, quantile_disc(l_extendedprice::DOUBLE, 0.05) AS q05, quantile_disc(l_extendedprice::DOUBLE, 0.5) AS q50, quantile_disc(l_extendedprice::DOUBLE, 0.95) AS q95 FROM x_lineitem GROUP BY 1"),
        "scale_single": _cte("lineitem", body="SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) * 4.0::DOUBLE AS est FROM x_lineitem WHERE pid IN (3, 1) GROUP BY 1, 2"),
        "true_error": _cte("lineitem", body=f"SELECT count(*) AS n_groups, round(avg(abs({PARTITIONS} * (part / 3) - whole) / abs(whole)), 6) AS mean_error FROM (SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS whole, CAST(sum(CASE WHEN pid IN (3, 1, 4) THEN l_quantity END) AS DOUBLE) AS part FROM x_lineitem GROUP BY 1, 2) WHERE part IS NOT NULL"),
        "coverage": _cte("orders", "lineitem", body=f"SELECT ((SELECT count(DISTINCT pid) FROM x_orders WHERE pid IN (3, 1, 4)) + (SELECT count(DISTINCT pid) FROM x_lineitem WHERE pid IN (3, 1, 4))) / {2 * PARTITIONS}.0::DOUBLE AS share"),
        "random_paths": _path_cte(f"SELECT p0, p1, p2 FROM paths ORDER BY {draw('p0', 'p1', 'p2')} LIMIT 20"),
        "draw_paths": _cte("orders", "lineitem", body=f"SELECT p0, p1 FROM (SELECT DISTINCT a.pid AS p0, b.pid AS p1 FROM {_OI}) ORDER BY {draw('p0', 'p1')} LIMIT 5"),
        "cms_build": _cte("orders", body=f"SELECT pid, depth, cell, count(*) AS n FROM ({cells('o_custkey', 'x_orders')}) GROUP BY ALL"),
        "cms_join_size": _cte("customer", "orders", body=f"""SELECT left_pid, right_pid, CAST(min(size) AS BIGINT) AS join_size FROM (
          SELECT a.pid AS left_pid, b.pid AS right_pid, depth, sum(a.n * b.n) AS size
          FROM (SELECT pid, depth, cell, count(*) AS n FROM ({cells('c_custkey', 'x_customer')}) GROUP BY ALL) a
          JOIN (SELECT pid, depth, cell, count(*) AS n FROM ({cells('o_custkey', 'x_orders')}) GROUP BY ALL) b USING (depth, cell) GROUP BY ALL)
          GROUP BY ALL HAVING count(*) = 5"""),
        "universe_crc32": f"""WITH RECURSIVE steps(o_orderkey, t, i, bit, c) AS (
          SELECT o_orderkey, {o}, 1, 8, xor(4294967295::BIGINT, CAST(ascii(substr({o}, 1, 1)) AS BIGINT)) FROM orders
          UNION ALL
          SELECT o_orderkey, t, CASE WHEN bit = 1 THEN i + 1 ELSE i END, CASE WHEN bit = 1 THEN 8 ELSE bit - 1 END,
                 xor(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, CASE WHEN bit = 1 AND i < length(t) THEN CAST(ascii(substr(t, i + 1, 1)) AS BIGINT) ELSE 0 END)
          FROM steps WHERE i <= length(t))
        SELECT * FROM (SELECT o_orderkey, CAST(xor(c, 4294967295::BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM steps WHERE i > length(t)) WHERE u < 0.1::DOUBLE""",
        "weighted_order": f"SELECT c_custkey, round(-ln(({_unit('CAST(c_custkey AS VARCHAR)')} * 4294967296.0::DOUBLE + 0.5) / 4294967296.0::DOUBLE) / c_nationkey, 6) AS draw FROM customer WHERE c_nationkey > 0",
        "live_paths": _path_cte("SELECT p0, p1, p2, s0, s1, 1.0::DOUBLE AS weight FROM sized WHERE s0 > 0 AND s1 > 0"),
        "path_weight": _path_cte(weight),
        "path_weight_groups": _path_cte(f"SELECT p0, p1, p2, g AS weight FROM paths JOIN {groups} USING (p1)"),
        "path_zscore": _path_cte(f"SELECT p0, p1, p2, round(z, 6) AS z, round(0.5 * (1 - CASE WHEN max(z) OVER () > min(z) OVER () THEN (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) ELSE 0 END) + 0.5, 6) AS weight FROM (SELECT p0, p1, p2, abs(m0 - m1) / sqrt(e0 + e1) + abs(m1 - m2) / sqrt(e1 + e2) AS z FROM paths JOIN {st('c_custkey', 'x_customer', 0)} USING (p0) JOIN {st('o_custkey', 'x_orders', 1)} USING (p1) JOIN {st('l_orderkey', 'x_lineitem', 2)} USING (p2))"),
        "rank_paths": _path_cte(f"SELECT * FROM ({weight}) ORDER BY weight DESC, p0, p1, p2 LIMIT 10"),
        "progressive_single": _cte("lineitem", body=" UNION ALL ".join(_cluster_sql(k) for k in (2, 3))),
        "progressive_join": _cte("orders", "lineitem", body=join_steps),
        "accumulate_partitions": _cte("orders", body="SELECT o_orderkey, pid FROM x_orders WHERE pid IN (3, 1)"),
        "accumulate_paths": _cte("orders", "lineitem", body=f"{item} {_OI} WHERE a.pid IN (3, 1)"),
        "accumulate_dedup": _cte("orders", body="SELECT o_orderkey, pid FROM x_orders WHERE pid IN (3, 1, 4)"),
        "hash_md5_a": f"SELECT o_orderkey, {_unit(o)} AS h FROM orders",
        "hash_md5_b": f"SELECT o_orderkey, {_unit(o, 1)} AS h FROM orders",
        "hash_java": f"SELECT o_orderkey, CAST({signed} AS BIGINT) AS h FROM orders",
        "hash_mult": f"SELECT o_orderkey, (CAST(({signed}) & 268435455 AS DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS h FROM orders",
        "universe_md5": f"SELECT o_orderkey FROM orders WHERE {_unit(o)} < 0.1::DOUBLE",
        "universe_join": f"SELECT l_linestatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {_unit(o)} < 0.1::DOUBLE GROUP BY 1",
        "uniform_groups": f"SELECT o_orderkey, CAST(floor({_unit(o)} * 10) + 1 AS INTEGER) AS grp FROM orders",
        "range_sample": f"SELECT o_orderkey FROM orders WHERE floor({_unit(o)} * 100) >= 20 AND floor({_unit(o)} * 100) < 35",
        "stratified_hash": f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {_unit(f"o_orderpriority || '|' || {o}")} < 0.1::DOUBLE",
        "bernoulli_hash": f"SELECT o_orderkey FROM orders WHERE {_unit(f"{o} || '|row'")} < 0.1::DOUBLE",
    }
