"""Greedy farthest-point selection (k centres) by rounds over cached distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored


def _distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b))


def farthest_points(vectors: DataFrame, k: int, id_col: str, vec_col: str, groups: list[str] | None = None) -> DataFrame:
    """groups, id, rank (from 0), distance: ``k`` vectors of each group, each the farthest from those before it (null for the first).

    The first is the one with the least id, ties go to the lesser id; a group
    of fewer vectors gives all of them.  Each round is one aggregation that
    finds every group's farthest vector, combined in tasks before the shuffle,
    and one pass that lowers the cached distances to it; a table is written
    every eight rounds.  Null vectors and null ids are left out, copies of a
    chosen vector come last, with distance 0.  Vectors of a group must have one
    length; distances to others are null, and such vectors come last too.
    """
    groups = groups or []
    key = [F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("\0null")) for g in groups]
    state = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.concat_ws("\0", *key).alias("__g") if groups else F.lit("").alias("__g"), *(F.col(f"`{g}`") for g in groups), F.col(id_col).alias("__id"), F.col(vec_col).alias("__x"), F.lit(None).cast("double").alias("__d"))
    chosen = None
    for rank in range(k):
        # The farthest by (distance, lesser id): unchosen ones have a distance of 0 or more, chosen ones are gone.
        best = state.groupBy("__g").agg(F.min_by(F.struct("__id", "__x", "__d"), F.struct(-F.coalesce("__d", F.lit(-1.0 if rank else 0.0)), "__id")).alias("__b"))
        best = stored(best.select(F.col("__g").alias("__h"), "__b.__id", "__b.__x", F.col("__b.__d").alias("__best")).withColumnsRenamed({"__id": "__chosen", "__x": "__y"}))
        if best.isEmpty():
            break
        picked = best.select("__h", F.col("__chosen").alias("id"), F.lit(rank).alias("rank"), F.col("__best").alias("distance"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        left = state.join(best, state["__g"] == best["__h"]).filter(F.col("__id") != F.col("__chosen"))
        state = left.withColumn("__d", F.least(F.coalesce("__d", F.lit(float("inf"))), F.when(F.size("__x") == F.size("__y"), _distance(F.col("__x"), F.col("__y"))).otherwise(F.coalesce("__d", F.lit(-1.0))))).drop("__h", "__chosen", "__y", "__best")
        if rank % 8 == 7:
            state = stored(state)
    names = vectors.filter(F.col(vec_col).isNotNull()).select(*(F.col(f"`{g}`") for g in groups), F.concat_ws("\0", *key).alias("__g") if groups else F.lit("").alias("__g")).distinct()
    if chosen is None:
        return names.limit(0).select(*groups, F.lit(None).cast(vectors.schema[id_col].dataType).alias("id"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance"))
    return chosen.join(names, chosen["__h"] == names["__g"]).select(*groups, "id", "rank", F.when(F.col("distance") >= 0, F.col("distance")).alias("distance"))
