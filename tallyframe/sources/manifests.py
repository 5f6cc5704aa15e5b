"""Lists of ids that state their own size, nested question files, merged results or their shards, latest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Mismatch(ValueError):
    """A list that is not what it says."""


def _checked(ids: DataFrame, expected: int | None, path: str) -> DataFrame:
    n, distinct = ids.agg(F.count("*"), F.countDistinct("id")).first()
    if n != distinct:
        raise Mismatch(f"{path}: ids must be unique ({n} lines, {distinct} ids)")
    if expected is not None and n != expected:
        raise Mismatch(f"{path}: {n} ids, {expected} expected")
    return ids


def id_lines(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """id: the non-blank lines of a text file, which must be unique and as many as expected."""
    ids = spark.read.text(path).select(F.trim(F.col("value")).alias("id")).filter("id <> ''")
    return _checked(ids, expected, path)


def id_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id: the ids of a JSON file {"count": n, "ids": [...]}, plain or gzip; they must be unique and as many as it says."""
    one = spark.read.schema("count long, ids array<string>").option("multiLine", True).json(path)
    counts = one.select("count").collect()  # one row a file
    if len(counts) != 1 or counts[0][0] is None:
        raise Mismatch(f"{path}: no count")
    return _checked(one.select(F.explode("ids").alias("id")), counts[0][0], path)


def nested_tasks(spark: SparkSession, path: str, task: str, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """id, video, task and the fields of ``task`` (a schema) of a JSON file {video: {name: {...}}}, one row a task.

    ``keep`` may use all of these columns and is applied before anything else
    reads the rows; ``limit`` takes the first by id.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,struct<{task}>>>").alias("m"))
    rows = whole.select(F.explode("m").alias("video", "tasks")).select("video", F.explode("tasks").alias("task", "x")).filter("x IS NOT NULL")
    rows = rows.select(F.concat_ws("::", "video", "task").alias("id"), "video", "task", "x.*")
    rows = rows if keep is None else rows.filter(keep)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the first in ``order``, by a minimum that tasks combine."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("x")).select(key, "x.*")


def merged_or_shards(spark: SparkSession, folder: str, schema: str, key: str, merged: str = "results.jsonl", shards: str = "shard_*/results.jsonl") -> DataFrame:
    """The rows of a folder's merged file if it is there, else of its shards; of a repeated key the first by file and line stays."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{merged}")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(schema).json(f"{folder}/{merged if there else shards}")
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return first_per_key(placed, key, ["__file", "__block", "__line"]).drop("__file", "__block", "__line")


def latest(spark: SparkSession, pattern: str, schema: str, key: str) -> DataFrame:
    """Of each key the last record over all files of a pattern, files in the order of their names."""
    rows = spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("__file", "__block", "__line")).alias("x")).select(key, "x.*").drop("__file", "__block", "__line")
