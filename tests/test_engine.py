"""The approximate engine: oracles, properties and hand-made cases."""

import json
import math
import time
import urllib.error
import urllib.request

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions.hashing import bucket, java_hash, md5_unit
from tidemark.functions.sid import combine_sid
from tidemark.operators import accuracy, estimator, joingraph, samplers, statistics
from tidemark.plans import benchmark as bench
from tidemark.plans import sqlfront
from tidemark.plans.progressive import multi, multi_weighted, run, single, weighted_paths
from tidemark.plans.service import QueryService, serve
from tidemark.plans.spec import Agg, AggQuery, Params, exact
from tidemark.sources import tables as T
from tidemark.streaming.running import running_totals, start

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()


def rows(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v) if v is not None and not isinstance(v, (int, float, bool)) else v

    names = sorted(df.columns)
    return sorted(tuple(repr(plain(r[n])) for n in names) for r in df.select(*names).collect())


def sql_rows(text):
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    rel = con.sql(text)
    names = [c for c in rel.columns]
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v) if v is not None and not isinstance(v, (int, float, bool)) else v

    return sorted(tuple(repr(plain(r[i])) for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    assert rows(registry.queries()[name](spark, SF)) == sql_rows(registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_hashes(spark):
    df = spark.createDataFrame([("123",), ("hello",), ("1",)], "k string")
    got = {r.k: r for r in df.select("k", md5_unit(F.col("k")).alias("a"), md5_unit(F.col("k"), 1).alias("b"), java_hash(F.col("k")).alias("j")).collect()}
    assert got["123"].a == 0.12568243639543653 and got["123"].b == 0.6732334706466645
    assert got["hello"].j == 99162322 and got["1"].j == 49
    edge = spark.createDataFrame([(0.0,), (0.999,), (1.0,), (-0.1,)], "u double").select(bucket(F.col("u")).alias("b"))
    assert [r.b for r in edge.collect()] == [0, 99, 0, 0]


def test_sid_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1), (100, 100, 100), (11, 1, 11), (1, 11, 2), (0, 5, 0), (5, 0, 0)], "i int, j int, want int")
    assert all(r.s == r.want for r in df.withColumn("s", combine_sid([F.col("i"), F.col("j")], 100)).collect())
    three = spark.range(1, 101).crossJoin(spark.range(1, 101).select(F.col("id").alias("j"))).withColumn("k", F.lit(37))
    lo, hi = three.select(combine_sid([F.col("id"), F.col("j"), F.col("k")], 100).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert (lo, hi) == (1, 100)
    with pytest.raises(ValueError):
        combine_sid([F.lit(1), F.lit(2)], 50)


def test_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert df.agg(*(estimator.quantile("x", q).alias(str(i)) for i, q in enumerate((0.05, 0.5, 0.95)))).first()[:] == (1.0, 5.0, 10.0)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.floats(0, 5), max_size=12), st.integers(0, 5))
def test_draws_take_each_weighted_key_once(weights, seed):
    got = list(samplers.draws(weights, seed))
    assert sorted(got) == sorted(k for k, w in weights.items() if w > 0)
    assert got == list(samplers.draws(weights, seed))


def test_scale_by_choices():
    assert estimator.scale_by_choices([("unif", "a"), ("unif", "b")], 9) == pytest.approx(100)
    assert estimator.scale_by_choices([("univ", "k"), ("univ", "k")], 9) == pytest.approx(10)


def test_t_quantile():
    assert estimator.t_quantile(0.95, 1) == pytest.approx(6.3138, abs=1e-3)
    assert estimator.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)


@pytest.mark.parametrize("mode", ["cluster", "corrected"])
def test_all_partitions_give_the_exact_answer(spark, mode):
    t = T.with_partition(T.load_table(spark, SF, "lineitem"), "lineitem", 4)
    *_, last = single(bench.Q1, t, "lineitem", range(4), Params(error_tol=0, max_iterations=4, mode=mode))
    want = {(r.l_returnflag, r.l_linestatus): r for r in exact(bench.Q1, {"lineitem": t}).collect()}
    for r in last.estimates.collect():
        value = float(want[r.l_returnflag, r.l_linestatus][r.agg])
        assert r.est == pytest.approx(value, rel=1e-9) and r.ci_low == pytest.approx(value, rel=1e-6) and r.ci_high == pytest.approx(value, rel=1e-6)


def test_stops_early_and_joins(spark):
    t = T.with_partition(T.load_table(spark, SF, "lineitem"), "lineitem", 4)
    assert len(list(single(bench.Q1, t, "lineitem", range(4), Params(error_tol=1e9, max_iterations=4)))) == 2  # one partition has no interval
    both = {n: T.with_partition(T.load_table(spark, SF, n), n, 4) for n in ("orders", "lineitem")}
    *_, last = multi(bench.Q2, both, [(i, i) for i in range(4)], 4, Params(error_tol=0, max_iterations=4, mode="corrected"))
    want = {(r.l_linestatus, r.o_orderpriority): r.sum_revenue for r in exact(bench.Q2, both).collect()}
    assert all(r.est == pytest.approx(want[r.l_linestatus, r.o_orderpriority], rel=1e-9) for r in last.estimates.collect())


def test_coverage_of_cluster_intervals(spark):
    t = T.with_partition(T.load_table(spark, SF, "lineitem"), "lineitem", 8, by="md5").persist()
    q = AggQuery(("lineitem",), (Agg("sum", "l_quantity", "sum_qty"),))
    truth = exact(q, {"lineitem": t}).first()[0]
    inside = 0
    for seed in range(12):
        *_, last = single(q, t, "lineitem", range(8), Params(error_tol=0, max_iterations=4, seed=seed))
        r = last.estimates.first()
        inside += r.ci_low <= truth <= r.ci_high
    assert inside >= 7  # nominal 90 %


def test_nulls_and_empty_subsamples(spark):
    schema = "l_returnflag string, l_linestatus string, l_quantity decimal(12,2), l_extendedprice decimal(12,2), l_discount decimal(12,2), sid int"
    df = spark.createDataFrame([], schema).unionByName(spark.sql("select cast(null as string) l_returnflag, 'F' l_linestatus, cast(1 as decimal(12,2)) l_quantity, cast(null as decimal(12,2)) l_extendedprice, cast(0 as decimal(12,2)) l_discount, 0 sid"))
    got = {r.agg: r for r in estimator.reference(estimator.partials(df, bench.Q1), bench.Q1).collect()}
    assert got["sum_qty"].est == 1 and got["sum_qty"].ci_low is None and got["avg_price"].est is None and got["avg_disc"].error is None


def test_sketch_is_never_below_exact(spark):
    a = spark.createDataFrame([(i % 3, i % 7) for i in range(50)], "pid int, k int")
    b = spark.createDataFrame([(i % 2, i % 11 + 100 * (i % 2)) for i in range(60)], "pid int, k int")
    exact_ = {(r.left_pid, r.right_pid): r.join_size for r in statistics.exact_join_size(a, "k", b, "k").collect()}
    for width in (4, 4096):
        sketch = {(r.left_pid, r.right_pid): r.join_size for r in statistics.sketch_join_size(statistics.count_min(a, "k", width), statistics.count_min(b, "k", width)).collect()}
        assert all(sketch.get(k, 0) >= v for k, v in exact_.items())
    assert sketch == exact_


def test_paths_and_accuracy(spark):
    m = spark.createDataFrame([(0,), (1,)], "pid int")
    p = joingraph.paths([joingraph.edges(m, m), joingraph.edges(m, m)])
    assert p.count() == 8 and joingraph.new_paths(p, p.limit(3)).count() == 5
    none = spark.createDataFrame([], "agg string, g string, est double")
    r = accuracy.true_error(spark.createDataFrame([("a", 2.0)], "g string, v double"), "v", none, "x", ["g"]).first()
    assert (r.n_groups, r.mean_error) == (0, 1.0)


def test_sql_front(spark):
    schemas = {n: list(t) for n, t in T.TYPES.items()}
    for name in ("Q1", "Q2", "Q3", "Q6", "Q7_AVG"):
        q = getattr(bench, name)
        aggs = ", ".join(f"{a.func}({a.expr}) AS {a.alias}" for a in q.aggs)
        joins = " ".join(f"JOIN {e.right} ON {e.right}.{e.right_key} = {e.left}.{e.left_key}" for e in q.joins)  # sides swapped
        where = f"WHERE {' AND '.join(q.where)}" if q.where else ""
        got = sqlfront.parse(spark, f"SELECT {', '.join(q.groups)}, {aggs} FROM {q.tables[0]} {joins} {where} GROUP BY {', '.join(q.groups)}", schemas)
        assert (got.tables, got.joins, got.groups, [a.alias for a in got.aggs]) == (q.tables, q.joins, q.groups, [a.alias for a in q.aggs])
        t = {n: T.load_table(spark, SF, n) for n in q.tables}
        assert rows(exact(got, t)) == rows(exact(q, t))
    got = sqlfront.parse(spark, "select avg(case when l_returnflag = 'N' then l_quantity end) x, count(*) c from `lineitem` where l_linestatus = 'O'", schemas)
    assert [a.func for a in got.aggs] == ["avg", "count"] and "'O'" in got.where[0]
    for bad in ("select count(*) c from part, lineitem", "select max(l_tax) m from lineitem", "select l_tax from lineitem", "select count(*) c from orders left join lineitem on o_orderkey = l_orderkey"):
        with pytest.raises(ValueError):
            sqlfront.parse(spark, bad, schemas)
    assert sqlfront.tables(spark, "select * from `order` join lineitem on true") == ["order", "lineitem"]


def test_files(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA|null\n1|ASIA|x\n")
    T.to_parquet(spark, str(tmp_path), str(tmp_path / "p"), ["region"])
    df = T.load_table(spark, str(tmp_path / "p"), "region")
    assert sorted(map(tuple, df.collect())) == [(0, "AFRICA", None), (1, "ASIA", "x")]
    files = T.part_files(df)
    assert T.read_parts(spark, files[:1], "region").count() == 2 and T.file_manifest(df).agg(F.sum("n_rows")).first()[0] == 2
    T.write_csv(df.select("r_regionkey"), str(tmp_path / "c"))
    assert T.read_truth(spark, str(tmp_path / "c")).count() == 2
    T.write_history(df, str(tmp_path / "h"))
    T.write_table(df, str(tmp_path / "t"))
    T.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_read_what_they_drew(spark, tmp_path):
    t = T.lay_out(T.with_partition(T.load_table(spark, SF, "orders"), "orders", 4), str(tmp_path / "orders"))
    assert T.partition_ids(spark, str(tmp_path / "orders")) == [0, 1, 2, 3] and T.sub_directories(spark, str(tmp_path)) == ["orders"]
    scan = plan(t.where("pid = 2"))
    assert "PartitionFilters: [isnotnull(pid" in scan
    assert rows(t.where("pid = 2")) == rows(T.with_partition(T.load_table(spark, SF, "orders"), "orders", 4).where("pid = 2"))


def test_an_estimate_is_one_scan(spark):
    for name in ("estimate_single", "estimate_join"):
        text = plan(registry.queries()[name](spark, SF))
        initial = text.split("Initial Plan")[-1]
        assert initial.count("FileScan parquet") == {"estimate_single": 1, "estimate_join": 2}[name]
        if name == "estimate_single":
            assert initial.count("Exchange") <= 4


def test_weighted_paths_and_dispatch(spark):
    both = {n: T.with_partition(T.load_table(spark, SF, n), n, 4) for n in ("customer", "orders", "lineitem")}
    two = {n: both[n] for n in ("orders", "lineitem")}
    for weights in ("uniform", "size", "groups", "zscore"):
        got = weighted_paths(bench.Q2, two, weights).collect()
        assert {(r.p0, r.p1) for r in got} == {(i, i) for i in range(4)} and all(r.weight >= 0 for r in got)
    *_, last = multi_weighted(bench.Q2, two, Params(error_tol=0, mode="corrected"), "groups")
    assert sorted(last.read) == [(i, i) for i in range(4)] and last.scale == 1
    want = {(r.l_linestatus, r.o_orderpriority): r.sum_revenue for r in exact(bench.Q2, both).collect()}
    assert all(r.est == pytest.approx(want[r.l_linestatus, r.o_orderpriority], rel=1e-9) for r in last.estimates.collect())
    one = list(run(spark, "select l_linestatus, count(*) as n from lineitem group by l_linestatus", both, range(4), Params(error_tol=0, max_iterations=4)))
    assert [s.step for s in one] == [1, 2, 3, 4]
    assert {r.est for r in one[-1].estimates.collect()} == {float(r.n) for r in both["lineitem"].groupBy("l_linestatus").agg(F.count("*").alias("n")).collect()}
    paths = joingraph.paths([joingraph.edges(both["orders"], both["lineitem"])])
    drawn = {tuple(r) for r in joingraph.random_paths(paths, 5).collect()}
    assert len(drawn) == 5 and drawn == {tuple(r) for r in joingraph.random_paths(paths.repartition(3), 5).collect()}


def test_stored_statistics(spark, tmp_path):
    t = T.with_partition(T.load_table(spark, SF, "orders"), "orders", 4)
    c = T.with_partition(T.load_table(spark, SF, "customer"), "customer", 4)
    for _ in range(2):
        statistics.store_statistics({"orders": t, "customer": c}, {"orders": ["o_custkey"], "customer": ["c_custkey"]}, str(tmp_path))
    assert T.sub_directories(spark, str(tmp_path)) == ["customer", "orders"] and T.sub_directories(spark, str(tmp_path / "orders")) == ["o_custkey"]
    assert rows(statistics.load_statistics(spark, str(tmp_path), "orders", "o_custkey")) == rows(statistics.partition_statistics(t, "o_custkey"))
    sketches = [statistics.load_sketch(spark, str(tmp_path), *x) for x in (("customer", "c_custkey"), ("orders", "o_custkey"))]
    sizes = statistics.sketch_join_size(*sketches)
    assert rows(sizes) == rows(statistics.sketch_join_size(statistics.count_min(c, "c_custkey"), statistics.count_min(t, "o_custkey")))
    assert statistics.sketch_shape(0.001, 0.01) == (2719, 5)
    hot = t.withColumn("v", F.when(F.col("o_orderkey") % 2 == 0, 7).otherwise(F.col("o_orderkey")))
    assert {r.value for r in statistics.heavy_hitters(hot, "v", 0.2).collect()} == {7}
    query = AggQuery(("customer", "orders"), (Agg("count", "*", "n"),), (bench.CUSTOMER_ORDER,))
    *_, last = multi_weighted(query, {"customer": c, "orders": t}, Params(error_tol=0, max_iterations=99, mode="corrected"), "uniform", [sizes])
    assert last.estimates.first().est == exact(query, {"customer": c, "orders": t}).first()[0]


def test_service(spark):
    t = {n: T.with_partition(T.load_table(spark, SF, n), n, 4) for n in ("customer", "orders", "lineitem")}
    service = QueryService(lambda sql: run(spark, sql, t, range(4), Params(error_tol=0, mode="corrected")), keep=2)
    server = serve(service, 0)
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        for sql, steps, key in (
            ("select l_linestatus, sum(l_quantity) as q from lineitem group by l_linestatus", 3, "(q,F)"),
            ("select o_orderstatus, sum(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey group by o_orderstatus", 4, "(q,F)"),
            ("select max(l_tax) m from lineitem", 0, None),
        ):
            body = json.dumps({"query": sql}).encode()
            qid = json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/StartQuery", body)))["qID"]
            for _ in range(400):
                got = json.load(urllib.request.urlopen(f"{url}/GetQueryResult?qID={qid}"))
                if got["state"] != "running":
                    break
                time.sleep(0.2)
            assert got["step"] == steps and (got["state"] == "done" and key in got["result"] if key else got["state"].startswith("failed"))
        assert len(service._store) == 2
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{url}/GetQueryResult?qID=none")
    finally:
        server.shutdown()
        service.close()


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3).write.parquet(path)
    start(running_totals(spark, path, "lineitem", bench.Q1), "running").awaitTermination(120)
    batch = estimator.partials(T.load_table(spark, SF, "lineitem").withColumn("sid", F.lit(0)), bench.Q1).drop("sid")
    assert rows(spark.table("running")) == rows(batch)
