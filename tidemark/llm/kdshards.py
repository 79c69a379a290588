"""Shards as the leaves of a k-d tree over metadata, cut at weighted medians.

The points of the tree are the distinct texts, weighted with the bytes of all their copies, so equal texts stay
together; only a text whose copies hold more than a leaf's share is dealt, by hashed ids, into ``PIECES`` points to a
leaf's share. Dimensions are ordinal: the ranks of source and language among their sorted values (of copies that
differ the smallest), and the size in sixteenths of powers of two. A node that holds several leaves is cut along its
widest dimension (its range of ranks over the root's) at the rank that leaves each side its share of the bytes, and
within that rank by a hash of the text that is new on each level; leaves therefore hold nearly equal bytes. Only
DataFrame functions are used.

A level takes two aggregations, summed on the map side: bytes for each node, dimension and rank, which give the
dimension and the rank of the cut, and bytes for 65,536 hashes of the texts at that rank. Cuts stay tables, which are
joined; the driver holds two numbers. Nothing is sorted as a whole; slots come from counts of 4096 hashed ranges in
each shard and an order within each range.

Defined results: a null text has one byte (the end mark) and is equal to the empty text; null metadata and ids count
as empty; missing metadata columns have one value; rows that repeat both id and text are points alike and lie in one
shard; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, table, text_or_empty

DIMENSIONS = ("source", "lang", "size")
#: Points to a leaf's share of bytes for a text whose copies hold more than that.
PIECES = 64


def _hex(c: Column, digits: int) -> Column:
    """The number that the first hex digits of an MD5 make."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _points(docs: DataFrame) -> DataFrame:
    named = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c)
    body = text_or_empty().cast("binary")
    return docs.select("doc_id", (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("text_md5"), named("source"), named("lang"))


def _rank(units: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """Units with the rank of a text column among its distinct values, as ``r_<column>``; one row a value is ranked."""
    values = units.select(column).distinct().withColumn(f"r_{column}", F.row_number().over(Window.orderBy(column)).cast("long"))
    return units.join(broadcast_if_small(scratch.put(values, f"ranks-{column}")), column)


def _size_rank(size: Column) -> Column:
    bits = F.length(F.bin(size))
    return (bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))").bitwiseAND(F.lit(15).cast("long"))).cast("long")


def _cuts(now: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """(node, half, dim, rank, hash): of a node's texts those go left that lie below the rank, or at it up to the hash."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cells = F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"r_{c}").alias("rank")) for i, c in enumerate(DIMENSIONS)))
    open_ = now.where("n > 1")
    sums = scratch.put(open_.select("node", "n", "w", F.inline(cells)).groupBy("node", "n", "dim", "rank").agg(F.sum("w").alias("w")), f"sums{level}")
    ends = sums.groupBy("node", "n", "dim").agg((F.max("rank") - F.min("rank")).alias("wide"), F.sum("w").alias("whole"))
    if level == 1:
        scratch.put(ends.select("dim", F.greatest("wide", F.lit(1)).alias("root")), "root")
    root = scratch.spark.read.schema("dim int, root long").parquet(scratch.path("root"))  # three rows
    widest = ends.join(F.broadcast(root), "dim").groupBy("node").agg(F.max(F.struct((F.col("wide") / F.col("root")).alias("share"), (-F.col("dim")).alias("last"), F.col("whole"))).alias("x"))
    chosen = sums.join(widest.select("node", (-F.col("x.last")).alias("dim"), "x.whole"), ["node", "dim"]).withColumn("half", F.floor(F.col("n") / 2))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("rank"))
    reached = lambda df: df.withColumn("upto", upto_of(df)).where(big("upto") * F.col("n") >= big("whole") * F.col("half"))
    upto_of = lambda df: (F.col("base") + F.sum("w").over(Window.partitionBy("node").orderBy("hash"))) if "hash" in df.columns else upto
    first = lambda df, by: reached(df).groupBy("node", "n", "half", "whole", *(("dim", "rank") if by == "hash" else ("dim",))).agg(F.min(F.struct(by, "upto", "w")).alias("x"))
    ranks = scratch.put(first(chosen, "rank").select("node", "n", "half", "whole", "dim", "x.rank", (F.col("x.upto") - F.col("x.w")).alias("base")), f"ranks{level}")
    at = F.element_at(F.array(*(f"r_{c}" for c in DIMENSIONS)), F.col("dim") + 1)
    here = open_.drop("n").join(ranks, "node").where(at == F.col("rank")).select("node", "n", "half", "whole", "dim", "rank", "base", "w", _level_hash(level).alias("hash"))
    hashes = here.groupBy("node", "n", "half", "whole", "dim", "rank", "base", "hash").agg(F.sum("w").alias("w"))
    cut = first(hashes, "hash")
    goal = big("whole") * F.col("half")
    after, before = F.abs(big("x.upto") * F.col("n") - goal), F.abs((big("x.upto") - big("x.w")) * F.col("n") - goal)
    return scratch.put(cut.select("node", "half", "dim", "rank", (F.col("x.hash") - F.when(after < before, 0).otherwise(1)).alias("hash")), f"cuts{level}")


def _level_hash(level: int) -> Column:
    return _hex(F.concat_ws("|", F.lit(str(level)), F.col("piece").cast("string"), F.col("text_md5")), 4)


def kd_shards(docs: DataFrame, spark: SparkSession, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard): give the number of leaves, or the bytes a leaf should have."""
    scratch = Scratch(spark)
    points = scratch.put(_points(docs), "points")
    total = points.agg(F.sum("size")).first()[0] or 0
    leaves = leaves or max(1, -(-total // target_bytes))
    copies = points.groupBy("text_md5").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * leaves > total)  # fewer than there are leaves
    pieces = broadcast_if_small(scratch.put(copies.select("text_md5", F.ceil(F.col("bytes") * (PIECES * leaves) / F.lit(max(total, 1))).alias("pieces")), "pieces"))
    placed = points.join(pieces, "text_md5", "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(_hex(_id(), 8) % F.col("pieces")))
    units = placed.groupBy("text_md5", "piece").agg(F.sum("size").alias("w"), *(F.min(c).alias(c) for c in DIMENSIONS))
    ranked = _rank(_rank(scratch.put(units, "units"), "source", scratch), "lang", scratch)
    first = ranked.select("text_md5", "piece", "w", "r_source", "r_lang", _size_rank(F.col("size")).alias("r_size"), F.lit(0).alias("node"), F.lit(int(leaves)).alias("n"))
    now, level, most = scratch.put(first, "level0"), 0, int(leaves)
    while most > 1:
        level, most = level + 1, most - most // 2
        cuts = broadcast_if_small(_cuts(now, level, scratch))
        at = F.element_at(F.array(*(f"r_{c}" for c in DIMENSIONS)), F.col("dim") + 1)
        left = (at < F.col("rank")) | ((at == F.col("rank")) & (_level_hash(level) <= F.col("hash")))
        side = now.join(cuts, "node", "left").withColumn("left", left)
        node = F.when(F.col("half").isNull() | F.col("left"), F.col("node")).otherwise(F.col("node") + F.col("half")).cast("int")
        n = F.when(F.col("half").isNull(), F.col("n")).when(F.col("left"), F.col("half")).otherwise(F.col("n") - F.col("half")).cast("int")
        now = scratch.put(side.select("text_md5", "piece", "w", *(f"r_{c}" for c in DIMENSIONS), node.alias("node"), n.alias("n")), f"level{level}")
        scratch.drop(*(f"{t}{level}" for t in ("sums", "ranks", "cuts")), f"level{level - 1}")
    shard = now.select("text_md5", F.col("piece").cast("long").alias("piece"), F.col("node").alias("shard"))
    return placed.withColumn("piece", F.col("piece").cast("long")).join(shard, ["text_md5", "piece"]).select("doc_id", "size", "text_crc32", "shard")


def with_slots(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard."""
    scratch = Scratch(spark)
    kept = scratch.put(rows.withColumn("b", _hex(F.concat_ws("|", F.col("text_crc32").cast("string"), _id()), 3)), "sharded")
    counts = kept.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "b").orderBy("text_crc32", "doc_id", "size"))
    return kept.withColumn("place", place).join(before, ["shard", "b"]).withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long")).drop("b", "place", "before")


def op9_kdshards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), spark, leaves=8)
    return with_slots(shards, spark).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _level_sql(k: int) -> str:
    """Units after the cuts of level k."""
    return f"""
c{k} AS (SELECT node, n, dim, rank, sum(w)::HUGEINT AS w FROM (SELECT node, n, w, unnest([0, 1, 2]) AS dim, unnest([r_source, r_lang, r_size]) AS rank FROM u{k - 1} WHERE n > 1) GROUP BY ALL),
e{k} AS (SELECT node, dim, max(rank) - min(rank) AS wide, sum(w)::HUGEINT AS whole FROM c{k} GROUP BY ALL),
d{k} AS (SELECT node, dim, whole FROM e{k} JOIN (SELECT dim, greatest(wide, 1) AS root FROM e1) USING (dim) QUALIFY row_number() OVER (PARTITION BY node ORDER BY wide::DOUBLE / root DESC, dim) = 1),
k{k} AS (SELECT node, n, n // 2 AS half, dim, whole, rank, upto - w AS base FROM (SELECT *, sum(w) OVER (PARTITION BY node ORDER BY rank) AS upto FROM c{k} JOIN d{k} USING (node, dim))
  WHERE upto * n >= whole * (n // 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY rank) = 1),
h{k} AS (SELECT *, base + sum(w) OVER (PARTITION BY node ORDER BY hash) AS upto FROM (
  SELECT node, k.n, half, dim, whole, rank, base, ('0x' || substr(md5('{k}|' || piece || '|' || text_md5), 1, 4))::BIGINT AS hash, sum(w)::HUGEINT AS w
  FROM u{k - 1} u JOIN k{k} k USING (node) WHERE [r_source, r_lang, r_size][dim + 1] = rank GROUP BY ALL)),
x{k} AS (SELECT node, half, dim, rank, hash - CASE WHEN abs(upto * n - whole * half) < abs((upto - w) * n - whole * half) THEN 0 ELSE 1 END AS hash
  FROM h{k} WHERE upto * n >= whole * half QUALIFY row_number() OVER (PARTITION BY node ORDER BY hash) = 1),
m{k} AS (SELECT u.*, half, ([r_source, r_lang, r_size][dim + 1] < rank OR ([r_source, r_lang, r_size][dim + 1] = rank AND ('0x' || substr(md5('{k}|' || piece || '|' || text_md5), 1, 4))::BIGINT <= hash)) AS le
  FROM u{k - 1} u LEFT JOIN x{k} USING (node)),
u{k} AS (SELECT text_md5, piece, w, r_source, r_lang, r_size, CASE WHEN half IS NULL OR le THEN node ELSE node + half END AS node, CASE WHEN half IS NULL THEN n WHEN le THEN half ELSE n - half END AS n FROM m{k})"""


OP9_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
points AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, md5(coalesce(text, '')) AS text_md5, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc),
total AS (SELECT sum(size) AS total FROM points),
copies AS (SELECT text_md5, CAST(ceil(sum(size) * {PIECES * 8} / max(total)) AS BIGINT) AS pieces FROM points, total GROUP BY 1 HAVING sum(size) * 8 > max(total)),
placed AS (SELECT p.*, CASE WHEN pieces IS NULL THEN 0 ELSE ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % pieces END AS piece FROM points p LEFT JOIN copies USING (text_md5)),
units AS (SELECT text_md5, piece, sum(size)::BIGINT AS w, min(source) AS source, min(lang) AS lang, min(size) AS size FROM placed GROUP BY ALL),
u0 AS (SELECT text_md5, piece, w, dense_rank() OVER (ORDER BY source) AS r_source, dense_rank() OVER (ORDER BY lang) AS r_lang,
       CAST(length(bin(size)) * 16 + ((size >> greatest(length(bin(size)) - 5, 0)) & 15) AS BIGINT) AS r_size, 0 AS node, 8 AS n FROM units),{",".join(map(_level_sql, (1, 2, 3)))}
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY node ORDER BY substr(md5(text_crc32 || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3), text_crc32, doc_id NULLS FIRST, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN u3 USING (text_md5, piece)
"""
