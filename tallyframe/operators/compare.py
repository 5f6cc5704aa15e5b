"""Comparisons of many arms with common draws, so that differences have honest intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS, SEED = 5000, 20260904


def cluster_weights(seeds: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights of clusters in all draws, each from a generator of its own seed (rows: clusters)."""
    return np.stack([np.random.default_rng(int(s) & 0x7FFFFFFFFFFFFFFF).poisson(1.0, draws) for s in seeds]).astype(np.float64) if len(seeds) else np.zeros((0, draws))


def compared(rows: DataFrame, cluster: str, arm: str, value: str, arms: list[str], contrasts: dict[str, dict[str, float]], groupings: list[str] | None = None, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """dimension, group, name, n, estimate, low, high: each arm's mean and each contrast, overall and by the ``groupings``.

    ``contrasts``: weights of arms by name, for example {"gain": {"new": 1,
    "old": -1}}.  ``rows`` has one row per cluster member and arm; an arm's
    mean is over its non-null values.  Clusters are summed by arm first, and
    each draws one set of weights that all arms, groups and contrasts share.
    Tasks add up their clusters, so draws times groups times arms sums are
    shuffled, whatever the number of rows.  An arm without values has nulls, and
    so has a contrast with it; n counts the values that go in.  A null group is
    "unknown"; null clusters are one cluster, rows of other arms are left out.
    """
    groupings = groupings or []
    which = F.array_position(F.array(*map(F.lit, arms)), F.col(arm).cast("string")) - 1
    # A grouping may vary inside a cluster: sums are by cluster and group, the weights by cluster alone.
    dims = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("group")), *(F.struct(F.lit(g).alias("dimension"), F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("unknown")).alias("group")) for g in groupings))
    long = rows.filter(F.col(arm).isin(arms)).select(F.col(cluster).cast("string").alias("c"), which.cast("int").alias("a"), F.col(value).cast("double").alias("v"), F.explode(dims).alias("d"))
    sums = long.groupBy("c", "d.dimension", "d.group", "a").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.count("v").alias("n"))
    held = sums.groupBy("c", "dimension", "group").agg(F.collect_list(F.struct("a", "s", "n")).alias("x"))  # one entry an arm
    held = held.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("c", F.lit("")), F.col("c").isNull()))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[str, str], np.ndarray] = {}
        for pdf in frames:
            for (dimension, group), part in pdf.groupby(["dimension", "group"], sort=False):
                got = totals.setdefault((dimension, group), np.zeros((2, len(arms), draws + 1)))
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    x = np.zeros((2, len(arms), len(some)))
                    for i, entries in enumerate(some["x"]):
                        for e in entries:
                            x[:, e["a"], i] = e["s"], e["n"]
                    got[:, :, :draws] += x @ cluster_weights(some["h"].to_numpy(), draws)
                    got[:, :, draws] += x.sum(2)  # the sums themselves, as a last draw
        for (dimension, group), got in totals.items():
            yield pd.DataFrame({"dimension": dimension, "group": group, "a": np.arange(len(arms)), "s": list(got[0]), "n": list(got[1])})

    drawn = held.mapInPandas(draw, "dimension string, group string, a int, s array<double>, n array<double>")
    flat = drawn.select("dimension", "group", "a", F.posexplode(F.arrays_zip("s", "n")).alias("draw", "x")).groupBy("dimension", "group", "draw", "a").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n"))
    means = flat.withColumn("m", F.col("s") / F.nullif(F.col("n"), F.lit(0.0))).groupBy("dimension", "group", "draw").agg(F.map_from_entries(F.collect_list(F.struct("a", "m"))).alias("m"), F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("n"))
    named = {x: {x: 1.0} for x in arms} | contrasts
    term = lambda w, f: [f(F.try_element_at("m", F.lit(arms.index(a))), k) for a, k in w.items()]
    made = F.array(*(
        F.struct(F.lit(name).alias("name"), sum(term(w, lambda m, k: m * F.lit(float(k))), F.lit(0.0)).alias("value"), sum((F.coalesce(F.try_element_at("n", F.lit(arms.index(a))), F.lit(0.0)) for a in w), F.lit(0.0)).cast("long").alias("n")) for name, w in named.items()
    ))
    each = means.select("dimension", "group", "draw", F.explode(made).alias("x")).select("dimension", "group", "draw", "x.*")
    point, drawn_value = F.col("draw") == draws, F.when(F.col("draw") < draws, F.col("value"))
    return each.groupBy("dimension", "group", "name").agg(
        F.max(F.when(point, F.col("n"))).alias("n"), F.max(F.when(point, F.col("value"))).alias("estimate"), F.percentile(drawn_value, F.lit(0.025)).alias("low"), F.percentile(drawn_value, F.lit(0.975)).alias("high")
    )
