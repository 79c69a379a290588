"""The star schema: delimited text to Parquet, typed tables, partitions and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import md5_bits

#: Column types of each table; columns that a source lacks are left out.
TYPES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "long", "r_name": "string", "r_comment": "string"},
    "nation": {"n_nationkey": "long", "n_name": "string", "n_regionkey": "long", "n_comment": "string"},
    "customer": {"c_custkey": "long", "c_name": "string", "c_address": "string", "c_nationkey": "int", "c_phone": "string", "c_acctbal": "decimal(12,2)", "c_mktsegment": "string", "c_comment": "string"},
    "supplier": {"s_suppkey": "long", "s_name": "string", "s_address": "string", "s_nationkey": "long", "s_phone": "string", "s_acctbal": "decimal(12,2)", "s_comment": "string"},
    "part": {"p_partkey": "long", "p_name": "string", "p_mfgr": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_container": "string", "p_retailprice": "decimal(12,2)", "p_comment": "string"},
    "partsupp": {"ps_partkey": "long", "ps_suppkey": "long", "ps_availqty": "int", "ps_supplycost": "decimal(12,2)", "ps_comment": "string"},
    "orders": {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "decimal(12,2)", "o_orderdate": "date", "o_orderpriority": "string", "o_clerk": "string", "o_shippriority": "int", "o_comment": "string"},
    "lineitem": {"l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "int", "l_quantity": "decimal(12,2)", "l_extendedprice": "decimal(12,2)", "l_discount": "decimal(12,2)", "l_tax": "decimal(12,2)", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date", "l_commitdate": "date", "l_receiptdate": "date", "l_shipinstruct": "string", "l_shipmode": "string", "l_comment": "string"},
}
#: What names a row for sampling, and the column whose residue deals rows to partitions.
ROW_KEY: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "partsupp": ("ps_partkey", "ps_suppkey"), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
}
PARTITIONS = 8


def typed(df: DataFrame, name: str) -> DataFrame:
    """Casts in a projection, so that column pruning and filters still reach the scan."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in TYPES[name].items() if c in df.columns))


def row_key(name: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in ROW_KEY[name]))


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "partsupp":
        items = load_table(spark, sf_dir, "lineitem")
        return items.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return typed(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


def load_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Typed tables as temporary views; ``order`` is another name of ``orders``."""
    tables = {name: load_table(spark, sf_dir, name) for name in TYPES}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    tables["orders"].createOrReplaceTempView("`order`")
    return tables


def read_delimited(spark: SparkSession, path: str, name: str, sep: str = "|") -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in TYPES[name].items())
    return spark.read.schema(schema).option("nullValue", "null").csv(path, sep=sep)


def to_parquet(spark: SparkSession, source: str, target: str, names: Sequence[str] = tuple(TYPES), mode: str = "errorifexists") -> None:
    """Delimited files ``<name>.tbl`` to Parquet tables ``<name>.parquet``."""
    for name in names:
        read_delimited(spark, f"{source}/{name}.tbl", name).write.mode(mode).parquet(f"{target}/{name}.parquet")


def part_files(df: DataFrame) -> list[str]:
    """The data files of a table; Spark leaves out checksums and markers."""
    return sorted(df.inputFiles())


def read_parts(spark: SparkSession, files: Sequence[str], name: str) -> DataFrame:
    """Reads the chosen part-files only."""
    return typed(spark.read.parquet(*files), name)


def sub_directories(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories below a path, whatever the file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(s.getPath().getName() for s in found if s.isDirectory())


def lay_out(df: DataFrame, path: str) -> DataFrame:
    """Writes a table with ``pid`` as one directory for each partition and returns it as read again.

    A filter on ``pid`` then reads the chosen directories only.
    """
    df.repartition("pid").write.mode("overwrite").partitionBy("pid").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partition_ids(spark: SparkSession, path: str) -> list[int]:
    """Partitions of a table that was laid out, from the names of its directories."""
    return sorted(int(d.split("=")[1]) for d in sub_directories(spark, path) if d.startswith("pid="))


def file_manifest(df: DataFrame) -> DataFrame:
    """(partition, n_rows) for each part-file."""
    return df.groupBy(F.input_file_name().alias("partition")).agg(F.count("*").alias("n_rows"))


def with_partition(df: DataFrame, name: str, n: int = PARTITIONS, by: str = "key") -> DataFrame:
    """Adds ``pid``: the residue of the first key column, or a bucket of the row key's MD5."""
    pid = F.pmod(F.col(ROW_KEY[name][0]), F.lit(n)) if by == "key" else F.pmod(md5_bits(row_key(name), 0), F.lit(n))
    return df.withColumn("pid", pid.cast("int"))


def partition_manifest(df: DataFrame, key: str) -> DataFrame:
    """(pid, n_rows, lo, hi): rows and key range of each partition."""
    return df.groupBy("pid").agg(F.count("*").alias("n_rows"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def partitions_in_range(manifest: DataFrame, lo, hi) -> DataFrame:
    """Partitions that a range predicate on the manifest's key cannot rule out."""
    return manifest.where((F.col("hi") >= F.lit(lo)) & (F.col("lo") <= F.lit(hi)))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for results of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_history(estimates: DataFrame, path: str) -> None:
    """Estimates and errors of all steps, a JSON line for each step, aggregate and group."""
    estimates.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Statistics and sketches; a rerun replaces them."""
    df.write.mode("overwrite").parquet(path)
