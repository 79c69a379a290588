"""Nearest neighbours by largest inner product as a block matrix join.

Vectors are scaled by a power of two and rounded to int8 before any exchange. Queries and candidates are packed into
blocks of bounded size and each pair of blocks meets once, in a tile: the int8 product, whose sums are exact in the
type they are taken in, gives every inner product with a bound on the error that follows from the rounding of both
vectors. A candidate survives a tile if its upper bound is not below the k-th largest lower bound there; the bounds
of all tiles are merged for each query, in batches, under the k-th largest lower bound of all. What survives that is
fetched by row from the original vectors, once, computed in double precision and ranked. So the result is exact.

Of equal vectors only those with the k + 1 smallest distinct ids are candidates, at most k rows of each: ties go to
the smaller id, so no other can be in a result. Spark limits these groups before it shuffles, so one very common
vector is a few rows from each task. Tiles are spread by keys of query block and candidate block; queries are a
stated twentieth of the rows, so that work is their product with the rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids; vectors of different lengths have no inner product and do not meet; a query has fewer than k results if there
are fewer candidates; of rows that repeat an id each is a candidate and each a query, and rows of the query's own id
are no candidates; a product that overflows to no number takes no part; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import dump, load
from .common import Scratch, table


def _usable(vec: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)


def quantised(m: np.ndarray) -> dict[str, np.ndarray]:
    """Rows as int8 times ``scale`` times 2 ** ``power``, with the norms of each rounded row and of its error before the power."""
    power = np.frexp(np.abs(m).max(axis=1))[1].astype(np.int64)
    unit = np.ldexp(np.ldexp(m, -(power // 2)[:, None]), -(power - power // 2)[:, None])  # in two steps, as 2 ** 1074 is no double
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return {"q": q, "scale": scale, "power": power, "norm": np.sqrt((back * back).sum(axis=1)), "error": np.sqrt(((unit - back) ** 2).sum(axis=1))}


def tile_bounds(a: dict[str, np.ndarray], b: dict[str, np.ndarray], k: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, lower and upper bound) of all that may be among the k best of a row of ``a``.

    Bounds are inner products over 2 ** (``top`` + the query's power).
    """
    d = a["q"].shape[1]
    kind = np.float32 if d * 127 * 127 < 1 << 24 else np.float64  # sums of products of int8 are exact in it
    right = b["q"].astype(kind).T
    lift = np.ldexp(1.0, b["power"] - top)
    rows = max(1, 1_000_000 // len(b["ids"]))  # some MB at a time
    for s in range(0, len(a["ids"]), rows):
        x = {n: v[s : s + rows] for n, v in a.items()}
        dots = (x["q"].astype(kind) @ right).astype(np.float64) * x["scale"][:, None] * b["scale"]
        # |q.c - q'.c'| <= |q'| |c - c'| + |q - q'| (|c'| + |c - c'|), and room for the rounding of doubles
        slack = x["norm"][:, None] * b["error"] + x["error"][:, None] * (b["norm"] + b["error"]) + 1e-9 * (x["norm"][:, None] * b["norm"])
        # what doubles cannot tell apart at their ends: results below the smallest and above the largest
        least = np.minimum(np.ldexp(float(d), np.maximum(-1070 - x["power"] - top, -1000)), 1e300)[:, None]
        most = np.ldexp(0.999, np.minimum(1024 - x["power"] - top, 1020))[:, None]
        low, high = np.minimum((dots - slack) * lift - least, most), (dots + slack) * lift + least
        own = x["ids"][:, None] == b["ids"]
        low[own], high[own] = -np.inf, -np.inf
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((high >= floor[:, None]) & ~own)
        yield s + i, j, low[i, j], high[i, j]


def nearest(vectors: DataFrame, spark: SparkSession, is_query: Column, k: int = 20, query_rows: int = 1024, candidate_rows: int = 32768, block_bytes: int = 32_000_000) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, vec) that ``is_query`` marks.

    A tile gives some k rows for each of its queries, so the more candidates a block has, the fewer rows there are.
    """
    scratch = Scratch(spark)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & _usable(F.col("vec")))
    rows = scratch.put(usable.select("vec_id", "vec", F.size("vec").alias("d"), is_query.alias("asks"), F.xxhash64("vec").alias("h"), F.monotonically_increasing_id().alias("row")), "rows")
    same = F.row_number().over(Window.partitionBy("h", "vec", "vec_id").orderBy("row"))
    near = F.dense_rank().over(Window.partitionBy("h", "vec").orderBy("vec_id"))
    few = rows.withColumn("x", same).where(F.col("x") <= k).withColumn("x", near).where(F.col("x") <= k + 1)

    def rounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch["d"].unique():
                part = batch[batch["d"] == d]
                x = quantised(np.vstack(part["vec"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"d": part["d"], "id": part["vec_id"], "row": part["row"], **{n: v for n, v in x.items() if n != "q"}, "q": [v.tobytes() for v in x["q"]]})

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        """Packs vectors of a length into blocks of about ``size``, and at most about ``block_bytes``, named by a hash of the row."""
        small = scratch.put(df.select("d", "vec_id", "vec", "row").mapInPandas(rounded, "d int, id long, row long, scale double, power long, norm double, error double, q binary"), f"{name}-int8")
        number = small.groupBy("d").agg(F.count("*").alias("n")).select("d", F.ceil(F.col("n") / F.least(F.lit(size), F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / F.col("d"))))).alias("n"))

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row")
            x = {n: pdf[n].to_numpy() for n in ("scale", "power", "norm", "error", "row")}
            return pd.DataFrame({"d": [int(pdf["d"].iloc[0])], name: [int(pdf[name].iloc[0])], "data": [dump(ids=pdf["id"].to_numpy(np.int64), q=np.frombuffer(b"".join(pdf["q"]), np.int8), **x)]})

        keyed = small.join(number, "d").withColumn(name, F.pmod(F.xxhash64("row", F.lit(3)), F.col("n"))).drop("n")
        return scratch.put(keyed.groupBy("d", name).applyInPandas(packed, f"d int, {name} long, data binary"), name)

    asking, offered = blocks(rows.where("asks"), query_rows, "qb"), blocks(few, candidate_rows, "cb")
    top = scratch.put(scratch.spark.read.parquet(scratch.path("cb-int8")).agg(F.max("power").alias("top")), "top").first()[0] or 0
    # each query block is sent to every candidate block of its length, and each candidate block to every query block
    numbers = lambda df, name: df.groupBy("d").agg(F.collect_set(name).alias("others"))
    left = asking.join(numbers(offered, "cb"), "d").withColumn("cb", F.explode("others")).drop("others")
    right = offered.join(numbers(asking, "qb"), "d").withColumn("qb", F.explode("others")).drop("others")

    def tiles(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"asker": [], "row": [], "low": [], "high": []})
        d = int(a["d"].iloc[0])
        x, y = ({**v, "q": v["q"].reshape(-1, d)} for v in (load(a["data"].iloc[0]), load(b["data"].iloc[0])))
        out = [(x["row"][i], y["row"][j], low, high) for i, j, low, high in tile_bounds(x, y, k, top)]
        return pd.DataFrame({n: np.concatenate(v) for n, v in zip(("asker", "row", "low", "high"), zip(*out, strict=True), strict=True)})

    found = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInPandas(tiles, "asker long, row long, low double, high double")

    def heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by query; of the query at hand only what may still be among the k best is held."""
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch])
            asker, low, high = (batch[n].to_numpy() for n in ("asker", "low", "high"))
            order = np.lexsort((-low, asker))
            start = np.concatenate(([True], np.diff(asker[order]) != 0))
            first = np.flatnonzero(start)
            size = np.diff(np.append(first, len(order)))
            kth = np.where(size >= k, low[order[np.minimum(first + k - 1, len(order) - 1)]], -np.inf)
            floor = np.empty(len(order))
            floor[order] = np.repeat(kth, size)
            batch = batch[high >= floor]
            last = batch["asker"] == asker[-1]
            held = batch[last]
            yield batch[~last][["asker", "row"]]
        if held is not None:
            yield held[["asker", "row"]]

    pairs = scratch.put(found.repartition("asker").sortWithinPartitions("asker").mapInPandas(heaps, "asker long, row long"), "pairs")
    asked = rows.select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    score = F.aggregate(F.zip_with("q", "vec", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    scored = pairs.join(rows.select("row", "vec_id", "vec"), "row").join(asked, "asker").select("asker", "query_id", "vec_id", "row", score.alias("score")).where(~F.isnan("score"))
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.select("vec_id", F.col("embedding").alias("vec")), spark, F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
