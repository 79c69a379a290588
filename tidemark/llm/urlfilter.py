"""URL filters over redirect equivalence.

Rules name a host, with all its subdomains, and a path prefix; the longest fitting rule judges a URL, and of
equally long ones an allow. URLs that no rule fits take the judgement of their aliases: the connected component
over redirect edges (meta refresh, or a table of redirects) and canonical-link edges. One allowed alias allows
the component, else one blocked alias blocks it, else it is allowed.

Edges of single pages are found with SQL expressions; components are found by distributed star contraction, so
that neither edges nor components come to the driver. Rules are joined on the host, each distinct pair of host
and path once; a host with a third of all pages is thereby one row for each path.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and has no alias but
those that a redirect table names; null html has no edges; repeated rows give repeated result rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, literal_rows, table
from .components import connected_components

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: Sequence[Rule] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``) and path (then up to ``?`` or ``#``)."""
    url = F.coalesce(url, F.lit(""))
    return _lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _node(url: Column) -> Column:
    """A URL without its fragment, as a 64-bit hash; the host's case does not matter."""
    host, _ = host_and_path(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(F.instr(url, "://") > 0, F.xxhash64(F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest))))


def _absolute(base: Column, link: Column) -> Column:
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when((link == "") | link.isNull(), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("?") | link.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), link))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): canonical links and immediate redirects that pages declare."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    canonical = F.regexp_extract(link, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    redirect = F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    src = F.col("url").cast("string")
    return (
        pages.where(src.isNotNull() & html.rlike("(?i)canonical|refresh"))
        .select(src.alias("src"), F.explode(F.array(_absolute(src, canonical), _absolute(src, redirect))).alias("dst"))
        .where("dst is not null")
    )


def judge(pages: DataFrame, spark: SparkSession, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict); ``redirects``: further edges (src, dst)."""
    scratch = Scratch(spark)
    host, path = host_and_path(F.col("url"))
    rows = scratch.put(pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node")), "rows")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = scratch.put(edges, "edges")
    targets = edges.select(F.explode(F.array("src", "dst")).alias("url"))
    sites = rows.select("host", "path", "node").unionByName(targets.select(host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node")))

    book = literal_rows(spark, [(v == "allow", h, p, h + p, len(h + p)) for v, h, p in rules], allow="boolean", r_host="string", r_path="string", rule="string", length="int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    places = sites.where("host <> ''").select("host", "path").distinct()
    fitted = (
        places.withColumn("r_host", F.explode(suffixes))
        .join(book, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("length", "allow", "rule")).alias("best"))
    )
    ruled = scratch.put(fitted.select("host", "path", "best.rule", "best.allow"), "ruled")

    roots = connected_components(edges.select(_node(F.col("src")).alias("u"), _node(F.col("dst")).alias("v")), scratch).distinct()
    marks = sites.join(ruled, ["host", "path"]).groupBy("node").agg(F.max("allow").alias("allow"))
    by_root = marks.join(roots, "node").groupBy("root").agg(F.max("allow").alias("by_alias"))
    aliased = scratch.put(roots.join(by_root, "root").select("node", "by_alias"), "aliased")
    verdict = F.coalesce("allow", "by_alias", F.lit(True))
    return rows.join(ruled, ["host", "path"], "left").join(aliased, "node", "left").select("page_id", "url", "host", "path", "rule", F.when(verdict, "allow").otherwise("block").alias("verdict"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark).drop("url")


def _rules_sql(rules: Sequence[Rule] = RULES) -> str:
    return ", ".join(f"({v == 'allow'}, '{h}', '{p}', '{h}{p}')" for v, h, p in rules)


OP5_SQL = rf"""
WITH RECURSIVE
book(allow, r_host, r_path, rule) AS (VALUES {_rules_sql()}),
declared AS (
  SELECT url AS base, regexp_extract(regexp_extract(html, '<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS raw FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'is') FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
links AS (
  SELECT base, replace(trim(raw, ' '), '&amp;', '&') AS link, regexp_extract(base, '^(.*?)://', 1, 's') AS scheme,
         regexp_extract(base, '^(.*?://[^/?#]*)', 1, 's') AS site, regexp_extract(base, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1, 's') AS folder
  FROM declared),
edges AS (
  SELECT base AS src, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN starts_with(link, '/') THEN site || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '?') OR starts_with(link, '#') THEN regexp_extract(base, '^([^?#]*)', 1, 's') || link
    ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || link END AS dst
  FROM links WHERE link <> ''),
urls AS (SELECT url FROM pages UNION SELECT src FROM edges WHERE dst IS NOT NULL UNION SELECT dst FROM edges WHERE dst IS NOT NULL),
cut AS (
  SELECT url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_ASCII_UPPER}', '{_ASCII_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest, translate(regexp_extract(url, '^(.*?)://', 1, 's'), '{_ASCII_UPPER}', '{_ASCII_LOWER}') AS scheme
  FROM urls),
sites AS (
  SELECT c.url, c.host, c.path, CASE WHEN contains(c.url, '://') THEN scheme || '://' || c.host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS node, b.rule, b.allow
  FROM cut c LEFT JOIN book b ON c.host <> '' AND (c.host = r_host OR ends_with(c.host, '.' || r_host)) AND starts_with(c.path, r_path)
  QUALIFY row_number() OVER (PARTITION BY c.url ORDER BY length(rule) DESC NULLS LAST, allow DESC) = 1),
steps AS (
  SELECT a.node AS a, b.node AS b FROM edges JOIN sites a ON a.url = src JOIN sites b ON b.url = dst WHERE a.node IS NOT NULL AND b.node IS NOT NULL
  UNION SELECT b.node, a.node FROM edges JOIN sites a ON a.url = src JOIN sites b ON b.url = dst WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
reach(n, r) AS (SELECT a, a FROM steps UNION SELECT n, b FROM reach JOIN steps ON r = a),
aliased AS (SELECT n, max(allow::INT) AS by_alias FROM reach JOIN sites ON node = r GROUP BY n)
SELECT p.page_id, s.host, s.path, s.rule, CASE WHEN coalesce(s.allow::INT, by_alias, 1) = 1 THEN 'allow' ELSE 'block' END AS verdict
FROM pages p JOIN sites s ON p.url IS NOT DISTINCT FROM s.url LEFT JOIN aliased ON n = s.node
"""
