"""Connected components of a link table, by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """v, component (the least vertex reachable): one row for each vertex of ``links`` (a, b), self-links and repeats allowed.

    Alternates two steps until nothing changes: every vertex hands its larger
    neighbours, then its smaller ones, to the least vertex it knows.  Minima
    are aggregated before the shuffle and met by plain joins, so a vertex with
    very many links is split like any hot join key; the number of rounds grows
    with the logarithm of the longest path.  An empty table has no rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        real = edges.filter("u <> v")
        both = real.unionByName(real.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(edges.select(F.col("v").alias("u"), "v")).unionByName(edges.select("u", F.col("u").alias("v"))).distinct())
        down = large.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        after = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).unionByName(large.filter("u = v")).distinct()
        )
        state = after.filter("u <> v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(edges)
        discard(large)
        edges = after
        if state == before or state[0] == 0:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "v")
        before = state
