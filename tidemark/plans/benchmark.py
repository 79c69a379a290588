"""The benchmark's queries over the tables at hand.

Where a column is missing there, another of its kind stands in: order priority for ship priority, brand for
container. The suppliers of parts are the pairs that line items name.
"""

from __future__ import annotations

from tidemark.plans.spec import Agg, AggQuery, JoinEdge

REVENUE = "l_extendedprice * (1 - l_discount)"
CUSTOMER_ORDER = JoinEdge("customer", "orders", "c_custkey", "o_custkey")
ORDER_ITEM = JoinEdge("orders", "lineitem", "o_orderkey", "l_orderkey")
EARLY = "o_orderdate < date'1995-03-15'"

Q1 = AggQuery(
    ("lineitem",),
    (Agg("sum", "l_quantity", "sum_qty"), Agg("avg", "l_extendedprice", "avg_price"), Agg("avg", "l_discount", "avg_disc"), Agg("count", "*", "count_order")),
    groups=("l_returnflag", "l_linestatus"),
)
Q2 = AggQuery(("orders", "lineitem"), (Agg("sum", REVENUE, "sum_revenue"),), (ORDER_ITEM,), groups=("l_linestatus", "o_orderpriority"))
Q3 = AggQuery(
    ("customer", "orders", "lineitem", "supplier"),
    (Agg("sum", REVENUE, "sum_revenue"),),
    (CUSTOMER_ORDER, ORDER_ITEM, JoinEdge("lineitem", "supplier", "l_suppkey", "s_suppkey")),
    groups=("c_mktsegment",),
)
Q4 = AggQuery(("lineitem",), (Agg("sum", "l_extendedprice * l_discount", "sum_revenue"),), where=("l_shipdate >= date'1994-01-01'", "l_discount between 0.05 and 0.07", "l_quantity < 24"))
PART_ITEM = (JoinEdge("part", "partsupp", "p_partkey", "ps_partkey"), JoinEdge("partsupp", "lineitem", "ps_partkey", "l_partkey"))
Q5_AVG = AggQuery(("part", "partsupp", "lineitem"), (Agg("avg", "l_extendedprice", "avg_yearly"),), PART_ITEM, groups=("p_brand",))
_CHAIN = (CUSTOMER_ORDER, ORDER_ITEM)
Q6 = AggQuery(("customer", "orders", "lineitem"), (Agg("sum", REVENUE, "sum_revenue"),), _CHAIN, (EARLY,), ("o_orderpriority", "o_orderstatus"))
Q6_AVG = AggQuery(("customer", "orders", "lineitem"), (Agg("avg", REVENUE, "avg_revenue"),), _CHAIN, (EARLY,), ("o_orderpriority", "o_orderstatus"))
Q7 = AggQuery(("customer", "orders", "lineitem"), (Agg("sum", REVENUE, "sum_revenue"),), _CHAIN, (EARLY,), ("o_orderdate",))
Q7_AVG = AggQuery(("customer", "orders", "lineitem"), (Agg("avg", REVENUE, "avg_revenue"),), _CHAIN, (EARLY,), ("o_orderdate",))
ALL = {"q1": Q1, "q2": Q2, "q3": Q3, "q4": Q4, "q5_avg": Q5_AVG, "q6": Q6, "q6_avg": Q6_AVG, "q7": Q7, "q7_avg": Q7_AVG}

#: Small line items of a part, against a fifth of the part's average: a correlated subquery, for SQL alone.
Q5_SQL = """
SELECT CAST(sum(l_extendedprice) AS DOUBLE) AS sum_yearly FROM part
JOIN partsupp ON p_partkey = ps_partkey JOIN lineitem ON ps_partkey = l_partkey
WHERE l_quantity < (SELECT 0.2 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)"""
