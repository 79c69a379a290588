"""Helpers the operators of this subpackage share: table access, scratch tables, text columns."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Removes a finished query's shuffle files at once instead of at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key as text modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


class Scratch:
    """Tables in the folder that driver and executors share, deleted when the application ends at the latest.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a session on one machine, as in
    tests, has a temporary folder; on a cluster it is an error.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark = spark
        self.root = f"{base or tempfile.mkdtemp(prefix='tidemark-')}/t-{uuid.uuid4().hex}"
        path, files = self._files(self.root)
        files.deleteOnExit(path)

    def _files(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Writes a table, which cuts the lineage, and returns it as read again."""
        with _settings(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name), partitionBy=list(partition_by) or None)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._files(self.path(name))
            files.delete(path, True)


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The session's settings while a table is written: small batches, as Python workers hold a batch of texts in several forms."""
    wanted = {_CLEANUP: "true", _BATCH: str(min(2000, int(spark.conf.get(_BATCH))))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_sent: set[str] = set()


def ships_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Sends this package to the executors, once for each application, before a query runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        context = spark.sparkContext
        if context.applicationId not in _sent:
            package = Path(__file__).resolve().parents[1]
            to = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
            with zipfile.ZipFile(to, "w") as z:
                for f in sorted(package.rglob("*.py")):
                    z.write(f, f.relative_to(package.parent))
            context.addPyFile(str(to))
            _sent.add(context.applicationId)
        return query(spark, *args, **kwargs)

    return run


def literal_rows(spark: SparkSession, rows: Sequence[tuple], **types: str) -> DataFrame:
    """A few rows from the driver as literals of a plan, whose size is thereby known."""
    structs = [F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, types.items(), strict=True))) for row in rows]
    none = F.array().cast(f"array<struct<{', '.join(f'{c}:{t}' for c, t in types.items())}>>")
    return spark.range(1).select(F.inline(F.array(*structs) if structs else none))


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marks a written table of a few short columns for broadcasting if it is counted to be small; else Spark's joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
