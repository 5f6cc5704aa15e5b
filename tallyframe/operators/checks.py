"""Checks of sets, distributions and summaries: reports as rows, and calls that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_report(a: DataFrame, b: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """One row: keys in both, in one alone, the first few of these, and what relation of sets holds."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    both = left.join(right, key, "full").withColumns({"only_a": F.col("r").isNull(), "only_b": F.col("l").isNull()})
    first = {side: both.filter(side).select(key).orderBy(key).limit(shown).agg(F.array_sort(F.collect_list(key)).alias(f"first_{side}")) for side in ("only_a", "only_b")}
    out = both.agg(F.count_if(~F.col("only_a") & ~F.col("only_b")).alias("both"), F.count_if("only_a").alias("only_a"), F.count_if("only_b").alias("only_b"))
    out = out.withColumns({"subset": F.col("only_a") == 0, "strict": (F.col("only_a") == 0) & (F.col("only_b") > 0), "disjoint": F.col("both") == 0, "equal": (F.col("only_a") == 0) & (F.col("only_b") == 0)})
    return out.crossJoin(F.broadcast(first["only_a"])).crossJoin(F.broadcast(first["only_b"]))  # one row each


def shard_report(shards: DataFrame, key: str, shard: str) -> DataFrame:
    """One row: keys, those in several shards, rows beyond the first of a key in its shard."""
    per = shards.groupBy(key).agg(F.countDistinct(shard).alias("s"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("keys"), F.count_if(F.col("s") > 1).alias("in_several"), F.sum(F.col("n") - F.col("s")).alias("repeats"))


def exactly(df: DataFrame, n: int) -> DataFrame:
    """``df`` if it has ``n`` rows; raises otherwise."""
    found = df.limit(n + 1).count()
    if found != n:
        raise ValueError(f"{n} rows expected, found {'more' if found > n else found}")
    return df


def one_value(df: DataFrame, column: str) -> DataFrame:
    """``df`` if all rows share a value of the column (a fingerprint); raises otherwise."""
    values = df.select(column).distinct().limit(2).collect()
    if len(values) > 1:
        raise ValueError(f"{column} has several values, such as {values[0][0]!r} and {values[1][0]!r}")
    return df


def probability_issues(p: Column, answer: Column, tolerance: float = 1e-6) -> Column:
    """Faults of a distribution (an array) and of the answer (an index) read from it."""
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.array_compact(
        F.array(
            F.when(~finite, "not finite"), F.when(F.exists(p, lambda x: (x < 0) | (x > 1)), "outside"), F.when(F.abs(whole - 1) > tolerance, "sum"),
            F.when(F.get(p, answer) < F.array_max(p) - tolerance, "not the greatest"),
        )
    )


def timing_issue(declared: Column, measured: Column, floor: float = 1.0, share: float = 0.02) -> Column:
    """Whether a measured duration departs from the declared one by more than the floor and the share."""
    return F.abs(declared - measured) > F.greatest(F.lit(floor), share * declared)


def reconciled(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose stored and recomputed values differ, or that only one side has: keys, stored, recomputed."""
    a, b = stored.select(*keys, F.col(value).alias("stored")), recomputed.select(*keys, F.col(value).alias("recomputed"))
    far = F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) > tolerance, ~F.col("stored").eqNullSafe(F.col("recomputed")))
    return a.join(b, keys, "full").filter(far)
