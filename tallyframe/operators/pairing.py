"""Paired views of the same samples: joins, deltas, tiers, capped selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in a total order (partial top-1 before the shuffle, no window over whole groups)."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return first.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def tier(delta_correct: Column, delta_p: Column, gain: float = 0.10) -> Column:
    """A: wrong to right; B: same outcome, probability up by ``gain``; C: right to wrong; D: the rest."""
    return (
        F.when(delta_correct == 1, "A").when((delta_correct == 0) & (delta_p >= gain), "B").when(delta_correct == -1, "C").otherwise("D")
    )


def paired(base: DataFrame, other: DataFrame, key: str, group: str) -> DataFrame:
    """Samples in both views (key, group, correct, p in each) with their deltas and tier.

    Deltas of probabilities are rounded to six places before tiers look at
    them.  Samples in one view only drop out; nulls make null deltas (tier D).
    """
    a = base.select(F.col(key), F.col(group), F.col("correct").alias("base_correct"), F.col("p").alias("base_p"))
    b = other.select(F.col(key), F.col("correct").alias("other_correct"), F.col("p").alias("other_p"))
    joined = a.join(b, key).withColumns(
        {"delta_correct": F.col("other_correct").cast("int") - F.col("base_correct").cast("int"), "delta_p": F.round(F.col("other_p") - F.col("base_p"), 6)}
    )
    return joined.withColumn("tier", tier(F.col("delta_correct"), F.col("delta_p")))


def capped_top(df: DataFrame, group: str, order: list[Column], cap: int, n: int) -> DataFrame:
    """The best ``n`` rows of a ranking with at most ``cap`` of a group: what a greedy scan would choose.

    Ranks are taken inside groups (with a group limit before the shuffle), so
    only the last top-n is global, and that is a partial sort per partition.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("group_rank", rank).filter(F.col("group_rank") <= cap).orderBy(*order).limit(n)


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("base_correct", "other_correct").agg(F.count("*").alias("n"))


def best_view(views: DataFrame, key: str, view: str, p: str, order: list[str]) -> DataFrame:
    """The view with the greatest probability for each sample; ties go to the first in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(view))
    return views.groupBy(key).agg(F.max_by(F.struct(view, p), F.struct(F.col(p), -place)).alias("b")).select(key, F.col(f"b.{view}").alias(view), F.col(f"b.{p}").alias(p))


def majority(votes: DataFrame, key: str, vote: str, anchor: DataFrame) -> DataFrame:
    """The strict majority of non-null votes, else the anchor's vote."""
    n = votes.filter(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.sum("n").alias("valid"), F.max_by(vote, F.struct("n", vote)).alias("top"), F.max("n").alias("most"))
    return anchor.join(top, key, "left").select(key, F.when(F.col("most") * 2 > F.col("valid"), F.col("top")).otherwise(F.col("anchor")).alias("choice"), F.coalesce(F.col("most") * 2 > F.col("valid"), F.lit(False)).alias("by_majority"))
