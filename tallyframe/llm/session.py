"""Shared folders, materialised tables and small bounded driver-side summaries."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that Spark hands to a Python task, instead of its own 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir).

    Where it is unset, a temporary one is set for a session whose tasks run in
    this process; on a cluster that is an error, as executors could not read it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH_BYTES at most, so that long texts do not fill a Python worker."""
    if int(spark.conf.get(_BATCH, str(64 << 20)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage without tying results to an executor: a lost executor
    costs only the tasks that it was running.  Spark drops the query's shuffle
    files as it ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tallyframe/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.search(r"/tallyframe/[0-9a-f]{32}$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than that."""
    return df.limit(bound + 1).count() <= bound


def small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows are within ``bound``, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if rows_within(df, bound) else df
