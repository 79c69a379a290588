"""SQL text to AggQuery through Spark's own parser; the tree is walked, texts are not cut."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.plans.spec import Agg, AggQuery, JoinEdge


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _plan(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _nodes(plan) -> list:
    return [plan, *(x for c in _all(plan.children()) for x in _nodes(c))]


def tables(spark: SparkSession, sql: str) -> list[str]:
    """Names in FROM order, subqueries in expressions apart."""
    return [n.tableName().split(".")[-1].strip("`") for n in _nodes(_plan(spark, sql)) if _kind(n) == "UnresolvedRelation"]


def _owner(column: str, aliases: dict[str, str], schemas: dict[str, list[str]]) -> str:
    parts = column.replace("`", "").split(".")
    if len(parts) > 1 and parts[-2] in aliases:
        return aliases[parts[-2]]
    found = [t for t in aliases.values() if parts[-1] in schemas.get(t, [])]
    if len(found) != 1:
        raise ValueError(f"{column} belongs to {found or 'no table'}")
    return found[0]


def parse(spark: SparkSession, sql: str, schemas: dict[str, list[str]]) -> AggQuery:
    """``schemas``: the columns of each table. Inner equi-joins and sum, avg, count; anything else is refused."""
    nodes = _nodes(_plan(spark, sql))
    kinds = [_kind(n) for n in nodes]
    for bad in ("Union", "Intersect", "Except", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Distinct"):
        if bad in kinds:
            raise ValueError(f"{bad} has no progressive form")
    names, aliases = [], {}
    for n in nodes:
        if _kind(n) == "UnresolvedRelation":
            name = n.tableName().split(".")[-1].strip("`")
            name = "orders" if name == "order" else name
            names.append(name)
            aliases.setdefault(n.tableName().strip("`"), name)
            aliases.setdefault(name, name)
        elif _kind(n) == "SubqueryAlias" and _kind(n.child()) == "UnresolvedRelation":
            base = n.child().tableName().strip("`")
            aliases[n.alias()] = "orders" if base == "order" else base
    joins = []
    for n in reversed([n for n in nodes if _kind(n) == "Join"]):
        if n.joinType().toString() != "Inner" or n.condition().isEmpty():
            raise ValueError("only inner joins with a condition")
        condition = n.condition().get()
        if _kind(condition) != "EqualTo":
            raise ValueError(f"not one equality: {condition.sql()}")
        sides = [c.sql() for c in _all(condition.children())]
        owners = [_owner(s, aliases, schemas) for s in sides]
        own = [s.replace("`", "").split(".")[-1] for s in sides]
        if names.index(owners[0]) > names.index(owners[1]):
            owners, own = owners[::-1], own[::-1]
        joins.append(JoinEdge(owners[0], owners[1], own[0], own[1]))
    if len(joins) != len(names) - 1:
        raise ValueError("each further table needs one join")
    where = tuple(n.condition().sql() for n in nodes if _kind(n) == "Filter")
    top = next((n for n in nodes if _kind(n) in ("Aggregate", "Project")), None)
    outputs = _all(top.aggregateExpressions() if _kind(top) == "Aggregate" else top.projectList())
    groups = tuple(g.sql().replace("`", "").split(".")[-1] for g in _all(top.groupingExpressions())) if _kind(top) == "Aggregate" else ()
    aggs = []
    for e in outputs:
        inner = e.child() if _kind(e) in ("Alias", "UnresolvedAlias") else e
        if _kind(inner) == "UnresolvedFunction":
            func = inner.nameParts().apply(0).lower()
            arg = _all(inner.arguments())[0].sql() if inner.arguments().size() else "*"
            expr = "*" if func == "count" and arg in ("*", "1") else arg
            aggs.append(Agg(func, expr, e.name() if _kind(e) == "Alias" else f"{func}_{len(aggs)}"))
        elif e.sql().replace("`", "").split(".")[-1] not in groups:
            raise ValueError(f"neither an aggregate nor a group: {e.sql()}")
    if not aggs:
        raise ValueError("no aggregate")
    return AggQuery(tuple(names), tuple(aggs), tuple(joins), where, groups)
