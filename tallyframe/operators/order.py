"""Places in a global or a group's order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Pairs of range and group up to which the counts before them are broadcast (some 24 bytes each).
BROADCAST_ROWS = 500_000


def positions(df: DataFrame, order: list[Column | str], groups: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``order``, by group if there are ``groups`` (null is a group).

    Rows are sorted by ranges; each range counts its rows of each group, and a
    row's place is its own within its range plus what earlier ranges have of
    the group.  So a group may be as large as the table.  The sorted rows are
    written to the shared folder once, as sampled ranges would not be the same
    in two jobs.  Ties are dealt places in no stated order, so let ``order``
    tell rows apart; a large group spreads over ranges only by its order.
    """
    groups, keys = groups or [], [F.col(o) if isinstance(o, str) else o for o in order]
    own = [F.col(f"`{g}`") for g in groups]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *own, *keys).sortWithinPartitions(*own, *keys)
    held = stored(ranged.withColumns({"__range": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = held.groupBy("__range", *groups).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*own).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    counts = counts.select(F.col("__range").alias("__r"), *(F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)), "__before")
    counts = F.broadcast(counts) if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else counts
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(groups):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    return held.join(counts, same).select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col("__row") + F.col("__before")).alias(name))


def batches(df: DataFrame, order: list[Column | str], size: int, groups: list[str] | None = None) -> DataFrame:
    """``df`` with batch (from 0) and place (in the batch, from 0): runs of ``size`` rows in order; a group's last may be shorter."""
    at = F.col("__position")
    return positions(df, order, groups, "__position").withColumns({"batch": F.floor(at / size).cast("long"), "place": at % size}).drop("__position")


def batch_faults(batched: DataFrame, keys: list[str], size: int, expected: int) -> DataFrame:
    """(fault, n): how the batches of a table miss covering ``expected`` rows once: repeated keys, gaps, overfull or short batches, too few or many rows."""
    by_key = batched.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated keys"))
    by_batch = batched.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last"))
    sums = by_batch.agg(
        F.count_if((F.col("places") != F.col("n")) | (F.col("last") != F.col("n") - 1)).alias("gaps in a batch"), F.count_if(F.col("n") > size).alias("overfull batches"),
        F.count_if(F.col("n") < size).alias("__short"), (F.coalesce(F.max("batch"), F.lit(-1)) + 1 - F.count("*")).alias("missing batches"), F.abs(F.coalesce(F.sum("n"), F.lit(0)) - expected).alias("rows too few or many"),
    )
    sums = sums.withColumn("short batches", F.greatest(F.lit(0), F.col("__short") - 1)).drop("__short")
    one = by_key.crossJoin(F.broadcast(sums))  # one row each
    listed = F.array(*(F.struct(F.lit(c).alias("fault"), F.col(f"`{c}`").cast("long").alias("n")) for c in one.columns))
    return one.select(F.explode(listed).alias("x")).select("x.*").filter("n > 0")
