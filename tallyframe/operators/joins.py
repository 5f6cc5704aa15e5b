"""Joins by strict coverage, by signature, against lists and against versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: keys expected and found, missing, extra and repeated."""
    a = expected.groupBy(key).agg(F.count("*").alias("n1"))
    b = found.groupBy(key).agg(F.count("*").alias("n2"))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("n1").isNotNull() & F.col("n2").isNotNull()).alias("matched"), F.count_if(F.col("n2").isNull()).alias("missing"),
        F.count_if(F.col("n1").isNull()).alias("extra"), F.count_if((F.col("n1") > 1) | (F.col("n2") > 1)).alias("repeated"),
    )


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join, if every key is in both sides once; raises otherwise."""
    report = coverage(left, right, key).first()
    if report["missing"] or report["extra"] or report["repeated"]:
        raise ValueError(f"join on {key}: {report.asDict()}")
    return left.join(right, key)


def signature(messages: Column) -> Column:
    """The hash of an array of (turn, role, text) without the assistant's turns."""
    asked = F.filter(F.array_sort(messages), lambda m: m["role"] != "assistant")
    return F.sha2(F.array_join(F.transform(asked, lambda m: F.concat_ws("|", m["role"], m["text"])), "\n"), 256)


def without_groups(df: DataFrame, used: DataFrame, group: str) -> DataFrame:
    """Rows whose group (not just whose sample) is nowhere in ``used``."""
    return df.join(used.select(group).distinct(), group, "left_anti")


def in_order(ids: list[int], df: DataFrame, key: str) -> DataFrame:
    """The rows of the listed ids with their places in the list."""
    spark = df.sparkSession
    listed = spark.createDataFrame(list(enumerate(ids)), f"place int, {key} long")
    return F.broadcast(listed).join(df, key)


def changes(old: DataFrame, new: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """Counts of values recovered (0 to 1), revoked (1 to 0) and kept between two versions."""
    both = old.select(key, *by, F.col(value).alias("v1")).join(new.select(key, F.col(value).alias("v2")), key)
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if((F.col("v1") == 0) & (F.col("v2") == 1)).alias("recovered"),
        F.count_if((F.col("v1") == 1) & (F.col("v2") == 0)).alias("revoked"), F.count_if(F.col("v1") == F.col("v2")).alias("same"),
    )


def overlay(base: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of the patch where it has one, else of the base, and which it was."""
    p = patch.select(key, F.col(column).alias("__new"))
    return base.join(p, key, "left").select(key, F.coalesce("__new", column).alias(column), F.col("__new").isNotNull().alias("patched"))
