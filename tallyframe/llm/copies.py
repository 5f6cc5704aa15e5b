"""Exact copies of texts, found by hash and set aside before costlier work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize, small

#: Copied texts up to which their hashes are broadcast (24 bytes each).
BROADCAST_ROWS = 500_000


def text_hash(text: str) -> Column:
    """64 bits of a text's SHA-256: t1 of :func:`mark_copies`."""
    return F.xxhash64(F.sha2(F.col(text).cast("binary"), 256))


def mark_copies(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (id, text) with t1, t2 (128 bits of the text's SHA-256) and copy: whether a smaller id has the same text.

    Hashes alone are shuffled, counted per task first; texts stay where they
    are as long as the copied texts are few enough to broadcast.  Null ids and
    null texts are nobody's copies.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    hashed = docs.withColumns({"t1": text_hash("text"), "t2": F.xxhash64(F.lit(1), digest)})
    groups = hashed.filter("text IS NOT NULL AND id IS NOT NULL").groupBy("t1", "t2").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    groups = materialize(groups.filter("leader < last").select("t1", "t2", "leader"))
    copy = F.col("text").isNotNull() & F.coalesce(F.col("id") > F.col("leader"), F.lit(False))
    return hashed.join(small(groups, broadcast_rows), ["t1", "t2"], "left").withColumn("copy", copy).drop("leader")
