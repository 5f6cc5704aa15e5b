"""Scores of results against labels, comparisons of arms, groupings of graded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assembly import complementarity
from .joins import strict_join


def graded(results: DataFrame, labels: DataFrame, key: str, prediction: str, answer: str, strict: bool = True) -> DataFrame:
    """Results with their labels and ``correct``: what is not parsed is wrong.  ``strict``: raises unless every key is in both once."""
    joined = strict_join(results, labels, key) if strict else results.join(labels, key)
    return joined.withColumns({"parsed": F.col(prediction).isNotNull(), "correct": F.coalesce(F.col(prediction) == F.col(answer), F.lit(False))})


def by_ladder(results: DataFrame, labels: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Results with the key of the label that the first of several fallback keys finds (null: none), each matched by joins of its own.

    A fallback key that several labels share finds nothing.
    """
    out = results
    for k in keys:
        found = labels.filter(F.col(k).isNotNull()).groupBy(k).agg(F.when(F.count("*") == 1, F.min(key)).alias(f"__{k}")).filter(F.col(f"__{k}").isNotNull()).withColumn("__zero", F.lit(0).cast("long"))
        # Rows without the key match nothing; they are dealt by their other columns, not to one task.
        spread = F.when(F.col(k).isNull(), F.pmod(F.xxhash64(*results.columns), F.lit(1000)) + 1).otherwise(0)
        out = out.withColumn("__null", spread).join(found.withColumnRenamed(k, "__key"), (F.col(k) == F.col("__key")) & (F.col("__null") == F.col("__zero")), "left").drop("__key", "__null", "__zero")
    return out.withColumn("matched", F.coalesce(*(f"__{k}" for k in keys))).drop(*(f"__{k}" for k in keys))


def gap_recovery(current: Column, initial: Column, teacher: Column, least: float = 1e-9) -> Column:
    """The share of the gap between an initial model and a teacher that is closed; null where there is next to no gap.

    Gap and share are rounded to 12 digits, so that the last bits of means decide neither about the least gap nor about a later rounding.
    """
    return F.when(F.round(F.abs(teacher - initial), 12) > least, F.round((current - initial) / (teacher - initial), 12))


def group_metrics(df: DataFrame, keys: list[str], correct: str, means: list[str]) -> DataFrame:
    """Rows, rows that are judged, correct ones, accuracy and means (nulls left out) of each group."""
    ok = F.col(correct)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(ok).alias("evaluated"), F.count_if(ok).alias("n_correct"), F.avg(ok.cast("int")).alias("accuracy"), *(F.avg(m).alias(f"mean_{m}") for m in means)
    )


def flip_tier(delta: Column) -> Column:
    """Tiers by the change of outcome alone; rows that cannot be compared are ineligible."""
    return F.when(delta.isNull(), "ineligible").when(delta == 1, "A").when(delta == 0, "B").otherwise("C")


def positive_tier(base: Column, other: Column, gap: Column, verified: Column) -> Column:
    """1: wrong to right; 2: right with a gain where a verified third view is wrong; 3: right with a gain; 99: none of these."""
    return F.when(~base & other, 1).when(other & (gap > 0) & ~verified, 2).when(other & (gap > 0), 3).otherwise(99)


def complement(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Which of two views are right; null if either is unknown."""
    return complementarity(a, b, names)


def in_all_views(rows: DataFrame, key: str, view: str, value: str, views: list[str]) -> DataFrame:
    """One row for each key that every view has, a column for each view (one pass, no chain of joins)."""
    return rows.filter(F.col(view).isin(views)).groupBy(key).pivot(view, views).agg(F.max(value)).dropna(subset=views)


def task_grid(axes: list[DataFrame], done: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of some short axes (each broadcast), with what is done and ``pending`` for the rest."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(F.broadcast(a))
    return grid.join(done.withColumn("__done", F.lit(True)), keys, "left").withColumn("pending", F.col("__done").isNull()).drop("__done")


def exploded(df: DataFrame, values: str, name: str) -> DataFrame:
    """A row for each value of an array; without any, one for ``unknown``."""
    some = F.when(F.size(values) > 0, F.col(values)).otherwise(F.array(F.lit("unknown")))
    return df.withColumn(name, F.explode(some))


def format_rates(strict: Column, correct: Column) -> dict[str, Column]:
    """How many rows keep to the strict format, and the accuracy of those."""
    return {"n_strict": F.count_if(strict), "n_strict_correct": F.count_if(strict & correct), "strict_accuracy": F.avg(F.when(strict, correct.cast("int")))}


def best_checkpoint(scores: DataFrame, arm: str, step: str, score: str) -> DataFrame:
    """The step of each arm with the best mean score; the earliest of equal ones."""
    mean = scores.groupBy(arm, step).agg(F.round(F.avg(score), 9).alias("mean"))
    return mean.groupBy(arm).agg(F.max_by(step, F.struct("mean", -F.col(step))).alias(step), F.max("mean").alias("mean"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: later ones win."""
    others = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return last.select(key, *(F.col(f"__row.{c}").alias(c) for c in others))
