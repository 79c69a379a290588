"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Every source gets the same level times its weight, but at most ``max_epochs`` times its size; the level is
raised, in rounds over the table of sources, until the whole volume is placed. Then each document is taken a
whole number of times, and documents in a seeded order once more until the source's target is met; the last
of them is taken in part, so that a source misses its target by less than one word.

The seeded order is cut in two steps: each source's sizes are summed over ``BUCKETS`` ranges of the order, and
only the range in which the target falls is ordered row by row. So a source that holds a third of all rows
is neither sorted in one task nor sent anywhere: no row is shuffled but those of the ranges that are cut.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; ids may be null or repeated (the order then falls to the text's hash; equal rows are alike); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_or_empty

#: 16**3: a range is named by three hex digits of the seeded MD5.
BUCKET_DIGITS = 3


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, scratch: Scratch) -> DataFrame:
    """Adds ``target`` to (source_no, weight, source_size): the level times the weight, capped.

    A round drains nothing but adds sources to the capped set; it ends when the level caps no more. Only
    three sums come to the driver in each round.
    """
    capacity = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = (F.col("weight") * F.lit(level) >= capacity) | (F.col("source_size") == 0)
        row = sources.agg(F.sum(F.when(full, capacity)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        above = (total - (row["held"] or 0.0)) / row["open"]
        if above <= level * (1 + 1e-15):
            break
        level = above
    return sources.withColumn("target", F.least(capacity, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, spark: SparkSession, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: float = 3, seed: str = "mix-1", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and the columns of ``keep`` for each row of ``docs``."""
    scratch = Scratch(spark)
    rows = docs.select(
        F.col("doc_id"),
        *keep,
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("doc_id").isNull(), F.md5(text_or_empty().cast("binary"))))).alias("o"),
    )
    sized = scratch.put(rows.drop(*keep), "sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row a source
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    sources = water_fill(scratch.put(ranked.withColumn("weight", F.element_at(weights, F.pmod("source_no", F.lit(len(cycle))) + 1)), "sources"), max_epochs, scratch)
    # whole repetitions, and the words that the seeded order has to add
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    )
    bucket = F.substring("o", 1, BUCKET_DIGITS)
    sums = sized.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("in_b"))
    before = F.coalesce(F.sum("in_b").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (
        sums.withColumn("before", before).alias("x").join(sources.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")))
        .where("before <= rest and before + in_b > rest")
        .select(F.col("y.source").alias("cut_source"), F.col("x.b").alias("cut_b"), F.col("x.before").alias("cut_before"))
    )
    of = scratch.put(
        sources.alias("y").join(cut, F.col("y.source").eqNullSafe(F.col("cut_source")), "left")
        .select(F.col("y.source").alias("s"), "source_size", "target", "whole", "rest", "cut_b", "cut_before"),
        "cuts",
    )
    # kept columns may be large: they are read again and not written
    placed = (rows if keep else sized).withColumn("b", bucket).join(of, F.col("source").eqNullSafe(F.col("s")))
    whole = F.col("whole") * F.col("size")
    away = placed.where("cut_b is null or b <> cut_b").withColumn("taken", whole + F.when(F.col("cut_b").isNull() | (F.col("b") < F.col("cut_b")), F.when(F.col("rest") > 0, F.col("size")).otherwise(0)).otherwise(0))
    run = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = placed.where("b = cut_b").withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cut_before") - run)))
    cols = [*keep, "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return away.select(*cols).unionByName(within.select(*cols))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), spark).drop("source")


OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || CAST(doc_id AS VARCHAR)) AS o
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY source),
rounds(k, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT k + 1, (SELECT (sum(source_size) - coalesce(sum(CASE WHEN weight * level >= 3 * source_size THEN 3 * source_size END), 0))
                      / sum(CASE WHEN NOT weight * level >= 3 * source_size THEN weight END) FROM by_source)
  FROM rounds WHERE k < 40),
top AS (SELECT max(level) AS level FROM rounds),
targets AS (SELECT s.*, least(3.0 * source_size, weight * level) AS target FROM by_source s, top),
parts AS (SELECT *, floor(target / source_size) AS whole, round(target - floor(target / source_size) * source_size) AS rest FROM targets),
runs AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM sized)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(p.whole * r.size + greatest(0, least(r.size, p.rest - r.run)) AS BIGINT) AS taken
FROM runs r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it.

    A repetition in part holds the first words of the text, joined by spaces, and its own number of characters.
    Rows travel whole through the mix, so that rows that repeat an id and a text are each taken as it says; a text
    without words goes; further columns are kept as they are, whatever their names; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    taken = mix(rows, spark, keep=("row_",)).where("taken > 0")
    again = taken.select("row_", "size", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))).alias("nth"))
    cut = F.col("nth") * F.col("size") > F.col("taken")
    words = F.filter(F.split("row_.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, 1, (F.col("taken") - F.col("size") * (F.col("nth") - 1)).cast("int")), " ")
    cells = {c: F.col("row_").getField(c) for c in docs.columns}
    cells["text"] = F.when(cut, part).otherwise(cells["text"])
    if "n_chars" in cells:
        cells["n_chars"] = F.when(cut, F.length(part)).otherwise(cells["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return again.select(*(v.alias(c) for c, v in cells.items()))
