"""Bootstrap intervals that never gather a group: Poisson resampling of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import positions

DRAWS, SEED = 2000, 20261003


def cluster_bootstrap(rows: DataFrame, groups: list[str], cluster: str, value: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Mean of ``value`` over each group and its 95 % percentile interval when clusters are resampled.

    Clusters are summed first.  Each cluster's weights in all draws are Poisson
    counts from a generator seeded by the cluster, so the result depends on
    neither order nor partitioning; tasks add their clusters up and only
    ``draws`` sums per group and task are shuffled.  Null values do not count;
    a group without values has nulls.
    """
    sums = rows.groupBy(*groups, F.col(cluster).cast("string").alias("__c")).agg(F.sum(value).cast("double").alias("__s"), F.count(value).cast("double").alias("__n"))
    seeded = sums.withColumn("__h", F.xxhash64(F.lit(seed), F.coalesce("__c", F.lit(""))))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                key = tuple(row[: len(groups)])
                w = np.random.default_rng(row[-1] & 0x7FFFFFFFFFFFFFFF).poisson(1.0, draws)
                got = totals.setdefault(key, np.zeros((2, draws)))
                got[0] += w * (0.0 if pd.isna(row[-3]) else row[-3])
                got[1] += w * row[-2]
        for key, got in totals.items():
            yield pd.DataFrame({g: [k] * draws for g, k in zip(groups, key)} | {"draw": np.arange(draws), "s": got[0], "n": got[1]})

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in groups)
    drawn = seeded.select(*groups, "__s", "__n", "__h").mapInPandas(draw, f"{kept}draw int, s double, n double")
    ratios = drawn.groupBy(*groups, "draw").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("r"))
    spread = ratios.groupBy(*groups).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    point = sums.groupBy(*groups).agg(F.sum("__n").cast("long").alias("n"), (F.sum("__s") / F.nullif(F.sum("__n"), F.lit(0.0))).alias("mean"))
    return point.join(spread, groups) if groups else point.crossJoin(F.broadcast(spread))


def paired_bootstrap(pairs: DataFrame, groups: list[str], delta: str, draws: int = 5000, seed: int = SEED) -> DataFrame:
    """Mean change of outcome (-1, 0 or 1; nulls left out) of each group and its 95 % percentile interval.

    A resample's mean depends on how many ups and downs it drew alone, which
    is a multinomial draw, so a group is three counts by then, whatever its
    size.  The generator is seeded by the group.
    """
    d = F.col(delta)
    counts = pairs.filter(d.isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(d == 1).alias("up"), F.count_if(d == -1).alias("down"))
    counts = counts.withColumn("h", F.xxhash64(F.lit(seed), *groups))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            low, high = [], []
            for r in pdf.itertuples(index=False):
                got = np.random.default_rng(r.h & 0x7FFFFFFFFFFFFFFF).multinomial(r.n, [r.up / r.n, r.down / r.n, 1 - (r.up + r.down) / r.n], draws)
                a, b = np.percentile((got[:, 0] - got[:, 1]) / r.n, [2.5, 97.5])
                low.append(a), high.append(b)
            yield pdf.assign(mean=(pdf.up - pdf.down) / pdf.n, low=low, high=high).drop(columns="h")

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pairs.schema if f.name in groups)
    return counts.mapInPandas(draw, f"{kept}n long, up long, down long, mean double, low double, high double")


def systematic(df: DataFrame, group: str, key: str, step: int) -> DataFrame:
    """Every ``step``-th row of each group in key order, with its place; no task holds a whole group."""
    return positions(df, [key], [group], "place").filter(F.col("place") % step == 0)
