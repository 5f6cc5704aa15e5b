"""Metrics over graded rows: summaries, bounds, intervals, grouping sets."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def tri_state(correct: Column) -> dict[str, Column]:
    """Counts and bounds of a Boolean whose null means undecided: accuracy only where nothing is undecided."""
    t, f, u = F.count_if(correct), F.count_if(~correct), F.count_if(correct.isNull())
    return {"n": F.count("*"), "n_true": t, "n_false": f, "n_undecided": u, "accuracy": F.when(u == 0, t / F.count("*")), "lower": t / F.count("*"), "upper": (t + u) / F.count("*")}


def aliased(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval; null without observations."""
    p, z2 = successes / n, Z95**2
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def mean_ci(x: Column) -> tuple[Column, Column, Column]:
    """Mean and its normal 95 % interval; of one value, the value itself."""
    mean, n = F.avg(x), F.count(x)
    half = F.when(n > 1, F.lit(1.96) * F.stddev_samp(x) / F.sqrt(n)).otherwise(0.0)
    return mean, mean - half, mean + half


@F.pandas_udf(DoubleType())
def _mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else two_sided_half(int(x), int(y)) for x, y in zip(b, c)], dtype=float)


#: Discordant pairs from which on the tail is taken from its expansion, which is exact to 1e-10 there.
MANY = 100_000


def two_sided_half(b: int, c: int) -> float:
    """Twice the chance of at most min(b, c) heads in b + c throws of a fair coin, 1 at most.

    The tail is a regularised incomplete beta function at a half, by its
    continued fraction; for very many throws the normal tail with a continuity
    correction and the next term of its expansion.
    """
    n, m = b + c, min(b, c)
    if b == c:
        return 1.0
    if n > MANY:
        z = (m + 0.5 - n / 2) / math.sqrt(n / 4)
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return min(1.0, max(0.0, math.erfc(-z / math.sqrt(2)) + 2 * density * (z**3 - z) / (12 * n)))
    # P(X <= m) = I(n - m, m + 1) at 1/2; the fraction converges fast as (p + 1) / (p + q + 2) > 1/2.
    p, q = n - m, m + 1
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) - (p + q) * math.log(2)) / p
    c_, d, i = 1.0, 1 / (1 - (p + q) / (p + 1) / 2), 1
    value = d
    while True:
        for top in (i * (q - i) / ((p + 2 * i - 1) * (p + 2 * i)) / 2, -(p + i) * (p + q + i) / ((p + 2 * i) * (p + 2 * i + 1)) / 2):
            d, c_ = 1 / (1 + top * d), 1 + top / c_
            value *= c_ * d
        if abs(c_ * d - 1) < 1e-15 or i > 10_000:
            return min(1.0, 2 * front * value)
        i += 1


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p-value of ``b`` and ``c`` discordant pairs, in time that grows with the root of their number at most; null stays null."""
    return _mcnemar(b.cast("long"), c.cast("long"))


def grouped(df: DataFrame, dimensions: list[str], columns: dict[str, Column]) -> DataFrame:
    """Metrics overall and for each dimension by itself, in one pass: (dimension, value, metrics)."""
    name, value = F.lit("overall"), F.lit("all")
    for d in dimensions:
        name = F.when(F.grouping(d) == 0, d).otherwise(name)
        value = F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(value)
    sets = [[], *([F.col(d)] for d in dimensions)]
    return df.groupingSets(sets, *dimensions).agg(name.alias("dimension"), value.alias("value"), *aliased(columns)).select("dimension", "value", *columns)


def contrast(df: DataFrame, key: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """The interaction a3 - a2 - a1 + a0 of four arms' means, over keys with all four."""
    wide = df.groupBy(key).pivot(arm, arms).agg(F.avg(value)).dropna()
    a0, a1, a2, a3 = (F.col(f"`{a}`") for a in arms)
    return wide.agg(F.count("*").alias("n"), F.avg(a3 - a2 - a1 + a0).alias("interaction"))
