"""Tables between phases, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_leaving: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set on a local master."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return str(base).rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, dealt out anew if it has fewer splits than two a slot.

    A small file may hold all its rows in one row group, which is one task whatever follows.  A scan of so few splits is at
    most two of spark.sql.files.maxPartitionBytes a slot; larger ones are left as they are and move nothing.
    """
    wanted = _wanted(df)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def _wanted(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def spread_once(df: DataFrame, name: str) -> DataFrame:
    """As spread(), for a scan that is read several times: its rows are dealt once, into a table of written(), not at each reading."""
    wanted = _wanted(df)
    return written(df.repartition(wanted), name, "zstd") if df.rdd.getNumPartitions() < wanted else df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _leave(spark: SparkSession, folder: str) -> None:
    with suppress(Exception):  # the session may have ended
        _delete(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's own folder, which goes when Python ends."""
    folder = f"{scratch_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}"
    if folder not in _leaving:
        _leaving.add(folder)
        atexit.register(_leave, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries started inside remove their shuffle files as they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df and read it back: lineage ends there, and what several steps need is computed once and survives a lost executor."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    with own_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; what is no such table stays."""
    for table in tables:
        if hasattr(table, "_scratch_path"):
            _delete(table.sparkSession, table._scratch_path)


def small(table: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A table of written(), to be broadcast if its files hold at most limit / 4 bytes.

    Decoded rows of numbers and short texts take about four times what their compressed files do.
    """
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(table) if 4 * size <= limit else table
