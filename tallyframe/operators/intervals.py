"""Interval algebra on rows (group, start, end) and on arrays of (s, e)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(spans: DataFrame, keys: list[str], start: str = "s", end: str = "e", halo: float = 0.0, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Spans widened by ``halo``, clamped to [low, high], and merged where they touch (keys, s, e)."""
    s, e = F.col(start) - halo, F.col(end) + halo
    s, e = (s if low is None else F.greatest(s, low)), (e if high is None else F.least(e, high))
    w = Window.partitionBy(*keys).orderBy("s", "e")
    moved = spans.select(*keys, s.alias("s"), e.alias("e")).filter("s < e")
    opened = moved.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), 1).otherwise(0)).over(w)
    return opened.withColumn("island", island).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "s", "e")


def gaps(merged: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between the merged spans of a group (keys, s, e)."""
    after = F.lead("s").over(Window.partitionBy(*keys).orderBy("s"))
    return merged.select(*keys, F.col("e").alias("s"), after.alias("e")).filter("e IS NOT NULL")


def best_overlap(a: DataFrame, b: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """For each group with spans on both sides, the greatest overlap of a span of ``a`` with one of ``b`` over their hull; 0 if none overlap.

    Spans meet in time bins of ``width`` (the mean length of all spans if not
    given, so that they fall into two bins each on average), so only spans near
    each other are paired, however many a group has.  A span without length,
    or with a null limit, overlaps nothing.
    """
    left, right = (x.select(*keys, F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e")) for x in (a, b))
    real = lambda x: x.filter("e > s")
    if width is None:
        width = real(left).unionByName(real(right)).agg(F.avg(F.col("e") - F.col("s"))).first()[0] or 1.0
    bins = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("__bin")
    near = real(left).select(*keys, F.col("s").alias("s1"), F.col("e").alias("e1"), bins).join(real(right).select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), bins), [*keys, "__bin"])
    shared = F.least("e1", "e2") - F.greatest("s1", "s2")
    best = near.filter(shared > 0).groupBy(*keys).agg(F.max(shared / (F.greatest("e1", "e2") - F.least("s1", "s2"))).alias("best_iou"))
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)
    return both.join(best, keys, "left").select(*keys, F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"))


def points_inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points that lie in some span of their group: merged spans first, so a point meets one span at most."""
    merged = union(spans, keys)
    return points.join(merged, [*keys]).filter((F.col(at) >= F.col("s")) & (F.col(at) <= F.col("e"))).select(*points.columns)


def midpoint_grid(low: Column, high: Column, n: int) -> Column:
    """The midpoints of ``n`` equal parts of [low, high]."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * (i + 0.5) / n)


def largest_remainder(df: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Whole shares of ``total`` in proportion to the weights; what is left over goes to the greatest remainders, ties by key.

    ``df`` has one row for each key of an allocation table, which is small
    next to what it is made from.
    """
    exact = F.col(weight) * F.lit(float(total)) / F.col("__sum")
    one = df.crossJoin(F.broadcast(df.agg(F.sum(weight).cast("double").alias("__sum")))).withColumn("__floor", F.floor(exact))
    left = F.lit(total) - F.col("__given")
    ranked = one.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc(F.round(exact - F.col("__floor"), 9)), *keys)))
    given = F.broadcast(one.agg(F.sum("__floor").alias("__given")))
    return ranked.crossJoin(given).select(*keys, weight, (F.col("__floor") + F.when(F.col("__rank") <= left, 1).otherwise(0)).cast("long").alias("share"))
