"""Progression as a stream: a file source that takes one part-file a trigger, with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.estimator import partials
from tidemark.plans.spec import AggQuery, filtered
from tidemark.sources.tables import typed


def running_totals(spark: SparkSession, path: str, name: str, query: AggQuery) -> DataFrame:
    """A streaming DataFrame of sums and counts for each group."""
    schema = spark.read.parquet(path).schema
    rows = typed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), name)
    from pyspark.sql import functions as F

    return partials(filtered(query, rows).withColumn("sid", F.lit(0)), query).drop("sid")


def start(totals: DataFrame, view: str) -> StreamingQuery:
    """Keeps the latest totals in a table in memory until all files are read."""
    return totals.writeStream.outputMode("complete").format("memory").queryName(view).trigger(availableNow=True).start()
