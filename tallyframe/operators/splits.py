"""Deterministic splits, caps and shards by hash rank, and deduplication policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .order import positions


def hash_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_cap(df: DataFrame, group: str, key: str, seed: int, n: int) -> DataFrame:
    """At most ``n`` rows of each group, the first by hash."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_key(seed, F.col(key)), key))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def hash_split(df: DataFrame, key: str, seed: int, parts: dict[str, float]) -> DataFrame:
    """``df`` with a split: the hash's first 32 bits against the parts' shares, alike however the rows are dealt."""
    at = F.conv(F.substring(hash_key(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    split, below = F.lit(list(parts)[-1]), 0.0
    chain = None
    for name, share in list(parts.items())[:-1]:
        below += share
        chain = F.when(at < below, name) if chain is None else chain.when(at < below, name)
    return df.withColumn("split", split if chain is None else chain.otherwise(split))


def strided_shards(df: DataFrame, group: str, key: str, shards: int) -> DataFrame:
    """Shard numbers dealt round by key order inside each group, which no task has to hold whole."""
    return positions(df, [key], [group], "__position").withColumn("shard", (F.col("__position") % shards).cast("int")).drop("__position")


def duplicates(df: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Keys held more than once: rows, distinct payloads and whether these conflict."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(payload).alias("payloads")).filter("n > 1").withColumn("conflict", F.col("payloads") > 1)


def sessions(events: DataFrame, user: str, at: str, gap_seconds: int) -> DataFrame:
    """Runs of a user's events without a pause longer than the gap."""
    w = Window.partitionBy(user).orderBy(at, "event_id")
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    numbered = events.withColumn("session", F.sum(F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)).over(w))
    return numbered.groupBy(user, "session").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def group_holdout(df: DataFrame, group: str, seed: int, n: int) -> DataFrame:
    """``df`` with ``held_out``: whether its group is among the ``n`` first by hash.  Groups stay whole; a top-n, no global window."""
    first = df.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(hash_key(seed, F.col(group)), group).limit(n)
    return df.join(first.withColumn("__held", F.lit(True)), group, "left").withColumn("held_out", F.col("__held").isNotNull()).drop("__held")


def quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Shares of ``total`` in proportion to the strata's sizes, one at least and no more than a stratum has.

    With more strata than places the largest get one each.
    """
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    if len(names) >= total:
        return {k: int(i < total) for i, k in enumerate(names)}
    whole = sum(sizes.values())
    exact = {k: sizes[k] * total / whole for k in names}
    out = {k: min(sizes[k], max(1, int(exact[k]))) for k in names}
    while sum(out.values()) != min(total, whole):
        short = sum(out.values()) < min(total, whole)
        able = [k for k in names if (out[k] < sizes[k] if short else out[k] > 1)]
        best = (max if short else min)(able, key=lambda k: (exact[k] - out[k], sizes[k]))
        out[best] += 1 if short else -1
    return out


def quota_table(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, quota by the rule of :func:`quotas`, over the table of strata (as strings); the driver gets four sums.

    A place more or less goes by how far a stratum's share is from its quota;
    each stratum's next places are rows with that distance, so the rule is a
    top-n over them, not a loop.
    """
    held = stored(df.filter(F.col(stratum).isNotNull()).groupBy(F.col(stratum).cast("string").alias("__s")).agg(F.count("*").alias("__n")))
    whole, n = held.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*")).first()
    if n >= total:
        first = held.orderBy(F.desc("__n"), "__s").limit(total).select("__s", F.lit(1).alias("__q"))
        return held.join(first, "__s", "left").select(F.col("__s").alias("stratum"), F.coalesce("__q", F.lit(0)).cast("int").alias("quota"))
    exact = F.col("__n") * total / F.lit(whole)
    start = held.withColumn("__q", F.least("__n", F.greatest(F.lit(1), F.floor(exact)))).withColumn("__far", exact - F.col("__q"))
    short = min(total, whole) - start.agg(F.sum("__q")).first()[0]
    places = F.least(F.col("__n") - F.col("__q") if short > 0 else F.col("__q") - 1, F.lit(abs(short)))
    each = start.filter(places > 0).select("__s", "__n", "__far", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("__j"))
    ordered = each.orderBy(F.desc(F.col("__far") - F.col("__j")), F.desc("__n"), "__s") if short > 0 else each.orderBy(F.col("__far") + F.col("__j"), "__n", "__s")
    moved = ordered.limit(abs(short)).groupBy("__s").agg(F.count("*").alias("__m"))
    change = F.coalesce("__m", F.lit(0)) * (1 if short > 0 else -1)
    return start.join(moved, "__s", "left").select(F.col("__s").alias("stratum"), (F.col("__q") + change).cast("int").alias("quota"))


#: Strata up to which their quotas are broadcast.
BROADCAST_ROWS = 500_000


def stratified(df: DataFrame, stratum: str, key: str, seed: int, total: int) -> DataFrame:
    """``total`` rows over the strata by :func:`quota_table`, the first by hash in each; rows without a stratum are left out."""
    table = quota_table(df, stratum, total).withColumnRenamed("stratum", "__stratum")
    table = F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_key(seed, F.col(key)), key))
    ranked = df.withColumn("rank", rank).filter(F.col("rank") <= total)
    return ranked.join(table, F.col(stratum).cast("string") == F.col("__stratum")).filter(F.col("rank") <= F.col("quota")).drop("quota", "__stratum")
