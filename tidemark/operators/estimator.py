"""Estimates with confidence intervals from partial aggregates.

A partial has a row for each group and subsample (or partition) with sum ``s`` and count ``c`` of one aggregate. All
steps are DataFrame operations over these few rows. Result columns: agg, the groups, est, ci_low, ci_high, error
(half the interval over its middle, in percent; null where the middle is 0 or there is no interval).

Three modes. ``reference``: sums scale the estimate but not the subsamples, averages are means over subsamples,
and ``alpha`` is cut off on either side. ``corrected``: subsamples are scaled to the whole and weighed by their
sizes. ``cluster``: the partitions read are the sampling units; fair where partitions differ.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.spec import Agg, AggQuery


def partials(df: DataFrame, query: AggQuery, by: str = "sid") -> DataFrame:
    """Sums and counts for each group and value of ``by``; additive, so partials of steps can be merged."""
    columns = []
    for a in query.aggs:
        if a.func != "count":
            columns.append(F.sum(F.expr(a.expr)).cast("decimal(38,4)").alias(f"{a.alias}__s"))
        columns.append((F.count("*") if a.expr == "*" else F.count(F.expr(a.expr))).alias(f"{a.alias}__c"))
    return df.groupBy(*query.groups, by).agg(*columns)


def merge_partials(parts: Sequence[DataFrame], query: AggQuery, by: str = "sid") -> DataFrame:
    whole = reduce(DataFrame.unionByName, parts)
    values = [c for c in whole.columns if c.endswith(("__s", "__c"))]
    return whole.groupBy(*query.groups, by).agg(*(F.sum(c).cast("decimal(38,4)" if c.endswith("__s") else "long").alias(c) for c in values))


def _value(a: Agg) -> Column:
    if a.func == "count":
        return F.col(f"{a.alias}__c").cast("double")
    s = F.col(f"{a.alias}__s").cast("double")
    return s if a.func == "sum" else s / F.col(f"{a.alias}__c")


def quantile(column: str, q: float) -> Column:
    """The element number ceil(q n) in ascending order; nulls do not count."""
    return F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY {column})")


def with_bounds(df: DataFrame) -> DataFrame:
    """Adds the relative error in percent."""
    middle = (F.col("ci_high") + F.col("ci_low")) / 2
    return df.withColumn("error", F.when(middle != 0, (F.col("ci_high") - F.col("ci_low")) / 2 / middle * 100))


def _long(parts: DataFrame, query: AggQuery, by: str) -> DataFrame:
    """A row for each aggregate, group and value of ``by``: agg, is_avg, x (its value), s and c (sum and count); one pass for all aggregates."""
    cells = []
    for a in query.aggs:
        c = F.col(f"{a.alias}__c")
        s = c.cast("decimal(38,4)") if a.func == "count" else F.col(f"{a.alias}__s")
        cells.append(F.struct(F.lit(a.alias).alias("agg"), F.lit(a.func == "avg").alias("is_avg"), _value(a).alias("x"), s.alias("s"), c.alias("c")))
    return parts.select(*query.groups, by, F.inline(F.array(*cells)))


def _pick(values: Column, q: float) -> Column:
    """The element number ceil(q n) of a sorted array; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.greatest(F.lit(1), F.ceil(F.round(n * F.lit(q), 9))).cast("int") - 1))


def reference(parts: DataFrame, query: AggQuery, sf: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """The number n of partial rows counts: the interval shrinks with its fourth root. Arrays hold a value for each subsample."""
    rows = _long(parts, query, "sid").groupBy("agg", "is_avg", *query.groups).agg(
        (F.sum(F.col("x").cast("decimal(28,6)")).cast("double") / F.count("x")).alias("mean"),
        (F.sum("s").cast("double") * sf).alias("total"),
        F.count("*").alias("rows"),
        F.sort_array(F.collect_list(F.when(F.col("sid") > 0, F.col("x")))).alias("xs"),
    )
    n = F.sum("rows").over(Window.partitionBy("agg")).cast("double")
    found = rows.withColumn("est", F.when(F.col("is_avg"), F.col("mean")).otherwise(F.col("total"))).withColumn("factor", F.sqrt(F.sqrt(n) / n))
    side = lambda q: F.col("est") - (_pick(F.col("xs"), q) - F.col("est")) * F.col("factor")
    return with_bounds(found.select("agg", *query.groups, "est", side(1 - alpha).alias("ci_low"), side(alpha).alias("ci_high")))


def corrected(parts: DataFrame, query: AggQuery, read: DataFrame, sf: float = 1.0, alpha: float = 0.05, b: int = 100, complete: bool = False) -> DataFrame:
    """``read``: (sid, m), tuples read before filters. If all is read the interval is the estimate."""
    sizes = read.agg(F.sum("m").cast("double").alias("n_read"), F.filter(F.collect_list(F.struct(F.col("sid"), F.col("m").cast("double").alias("m"))), lambda e: (e["sid"] > 0) & (e["sid"] <= b)).alias("sizes"))
    rows = _long(parts, query, "sid").groupBy("agg", "is_avg", *query.groups).agg(
        F.sum("s").cast("double").alias("s_all"),
        F.sum("c").cast("double").alias("c_all"),
        F.filter(F.collect_list(F.struct("sid", F.col("s").cast("double").alias("s"), F.col("c").cast("double").alias("c"))), lambda e: e["sid"] > 0).alias("own"),
    )
    every = rows.join(F.broadcast(sizes)).withColumn("est", F.when(F.col("is_avg"), F.col("s_all") / F.col("c_all")).otherwise(F.col("s_all") * sf))  # one row of at most b + 1 sizes
    of_mean = F.transform(F.filter("own", lambda e: e["c"] > 0), lambda e: F.sqrt(e["c"]) * (e["s"] / e["c"] - F.col("est")))
    sums = F.map_from_entries(F.transform("own", lambda e: F.struct(e["sid"], e["s"])))
    of_total = F.transform("sizes", lambda e: F.sqrt(e["m"]) * (F.coalesce(F.try_element_at(sums, e["sid"]), F.lit(0.0)) * (F.col("n_read") / e["m"]) * sf - F.col("est")))
    found = every.withColumn("d", F.sort_array(F.when(F.col("is_avg"), of_mean).otherwise(of_total))).withColumn("root", F.sqrt(F.when(F.col("is_avg"), F.col("c_all")).otherwise(F.col("n_read"))))
    side = lambda q: F.col("est") if complete else F.col("est") - _pick(F.col("d"), q) / F.col("root")
    return with_bounds(found.select("agg", *query.groups, "est", side(1 - alpha / 2).alias("ci_low"), side(alpha / 2).alias("ci_high")))


def t_quantile(p: float, df: int) -> float:
    """Student's t by bisection over Simpson's rule for its density."""
    if df < 1:
        return math.nan
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float, n: int = 2000) -> float:
        """The integral from 0 to t, over the angle whose tangent is x / sqrt(df)."""
        end = math.atan(t / math.sqrt(df))
        f = lambda a: c * math.sqrt(df) * math.cos(a) ** (df - 1)
        h = end / n
        return h / 3 * (f(0) + f(end) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))

    lo, hi = 0.0, 1e6
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p - 0.5 else (lo, mid)
    return (lo + hi) / 2


def cluster(parts: DataFrame, query: AggQuery, read: int, total: int, alpha: float = 0.1) -> DataFrame:
    """``parts`` by ``pid``; ``read`` of ``total`` partitions drawn with equal chances. Partitions without the group count as 0."""
    k, half = read, t_quantile(1 - alpha / 2, read - 1) if read > 1 else None
    fpc = math.sqrt(max(0.0, 1 - k / total))
    number = lambda c: F.col(c).cast("double")
    rows = _long(parts, query, "pid").groupBy("agg", "is_avg", *query.groups).agg(F.sum(number("s")).alias("t"), F.sum(number("c")).alias("c_all"), F.collect_list(F.struct(number("s").alias("s"), number("c").alias("c"))).alias("own"))
    found = rows.withColumn("est", F.when(F.col("is_avg"), F.col("t") / F.col("c_all")).otherwise(total * (F.col("t") / k)))
    found = found.withColumn("r", F.transform("own", lambda e: e["s"] - F.when(F.col("is_avg"), F.col("est") * e["c"]).otherwise(0.0)))
    add = lambda f: F.aggregate("r", F.lit(0.0), lambda x, y: x + f(y))
    whole = add(lambda y: y)
    deviation = F.sqrt(F.greatest(F.lit(0.0), (add(lambda y: y * y) - whole * whole / k) / (k - 1))) if k > 1 else F.lit(None).cast("double")
    scale = F.when(F.col("is_avg"), 1 / (F.col("c_all") / k)).otherwise(float(total))
    width = F.lit(half) * scale * fpc * deviation / math.sqrt(k)
    return with_bounds(found.select("agg", *query.groups, "est", (F.col("est") - width).alias("ci_low"), (F.col("est") + width).alias("ci_high")))


def scale_by_choices(choices: Sequence[tuple[str, str]], i: int) -> float:
    """1 over the share sampled: each uniform choice takes (i + 1) hundredths, a run of universe choices of one key once."""
    share, last = 1.0, None
    for kind, key in choices:
        if kind == "unif" or key != last:
            share *= (i + 1) / 100
        last = key if kind != "unif" else None
    return 1 / share
