"""Censuses of line files that are still being written, and of run folders made of them.

Lines are read by splits like any text, so a file may be of any size; what
tells a file's last line from the others, and whether it ends in a line feed,
is found by aggregation: places inside a file, and the sum of all lines' bytes
against the file's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Damaged(ValueError):
    """Complete lines inside files that are no JSON."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, size, modified of every file under ``path`` (a pattern or folder); contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def census(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """One row a file: file, rows, size, modified, age_s, incomplete_final_line, malformed_complete_lines.

    rows counts lines that are JSON; blank lines count as nothing.  A last
    line without a line feed that is no JSON is still being written; any other
    line that is no JSON is malformed.  Files without a byte are not listed,
    as Spark's readers pass over them (:func:`units` fills in expected units).
    A line must fit into memory, a file need not.
    """
    listed = files(spark, path)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")
    )
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == ""
    bad = ~blank & F.try_parse_json(F.col("value")).isNull()
    marked = lines.select("file", "at", F.octet_length("value").alias("bytes"), blank.alias("blank"), bad.alias("bad"))
    counted = marked.groupBy("file").agg(
        F.count_if(~F.col("blank") & ~F.col("bad")).alias("rows"), F.count_if(F.col("bad")).alias("n_bad"), F.max_by("bad", "at").alias("last_bad"), (F.sum(F.col("bytes").cast("long")) + F.count("*")).alias("closed")
    )  # tasks count their lines first, so a hot file is no hot task
    torn = F.coalesce(F.col("last_bad") & (F.col("closed") == F.col("size") + 1), F.lit(False))
    age = (F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros("modified")) / 1e6
    return listed.join(counted, "file", "left").select(
        "file", F.coalesce("rows", F.lit(0)).alias("rows"), "size", "modified", age.alias("age_s"), torn.alias("incomplete_final_line"), (F.coalesce("n_bad", F.lit(0)) - torn.cast("int")).cast("long").alias("malformed_complete_lines"),
    )


def rows_so_far(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of files that may still grow, without a torn last line; raises :class:`Damaged` if a complete line is no JSON.

    The census is one pass of its own, before any row is handed out.
    """
    wrong = census(spark, path).filter("malformed_complete_lines > 0")
    some = [f"{r.file}: {r.malformed_complete_lines}" for r in wrong.orderBy("file").limit(5).collect()]
    if some:
        raise Damaged("malformed complete lines in " + ", ".join(some))
    rows = spark.read.option("recursiveFileLookup", True).schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.filter("_torn IS NULL").drop("_torn")


def units(counted: DataFrame, expected: DataFrame) -> DataFrame:
    """unit, files, rows, expected, fraction, age_s, incomplete, malformed, phase of every expected unit (unit, expected, status), and of units nobody expects.

    ``counted`` is a census with a unit column.  A unit without files has no
    rows.  Phases: loading (running, no rows yet), else the unit's status;
    unexpected for a unit with files that is not in the list.
    """
    by_unit = counted.groupBy("unit").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.min("age_s").alias("age_s"), F.count_if(F.col("incomplete_final_line")).alias("incomplete"), F.sum("malformed_complete_lines").alias("malformed")
    )
    both = expected.select("unit", F.col("expected").cast("long").alias("expected"), F.coalesce("status", F.lit("unknown")).alias("status")).join(by_unit, "unit", "full")
    rows = F.coalesce("rows", F.lit(0))
    phase = F.when(F.col("status").isNull(), "unexpected").when((F.col("status") == "running") & (rows == 0), "loading").otherwise(F.col("status"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("unit", zero("files"), rows.alias("rows"), "expected", (rows / F.nullif(F.col("expected"), F.lit(0))).alias("fraction"), "age_s", zero("incomplete"), zero("malformed"), phase.alias("phase"))


def issues(of_units: DataFrame, stall_s: float) -> DataFrame:
    """id, kind, severity, unit: what is wrong with units.  Loading, a torn last line and a slow start are no issue."""
    c = F.col
    found = {
        "excess rows": (c("rows") > c("expected"), "error"), "malformed lines": (c("malformed") > 0, "error"), "failed": (c("phase") == "failed", "error"), "unexpected": (c("phase") == "unexpected", "warning"),
        "no recent activity": ((c("phase") == "running") & (c("age_s") > stall_s), "warning"), "short": ((c("phase") == "complete") & (c("rows") < c("expected")), "error"),
    }
    each = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for kind, (rule, severity) in found.items())))
    return of_units.select("unit", F.explode(each).alias("x")).select(F.concat_ws(":", "x.kind", "unit").alias("id"), "x.kind", "x.severity", "unit")


def run_folders(spark: SparkSession, path: str, file_name: str, schema: str, levels: list[str]) -> DataFrame:
    """The rows of ``file_name`` in every folder under ``path``, with the names of the last folders above it as columns ``levels`` (the outermost first)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name).schema(schema).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", *(F.try_element_at(parts, F.lit(-(len(levels) - i) - 1)).alias(name) for i, name in enumerate(levels)))


def shard_faults(rows: DataFrame, shard: str, key: list[str], contract: list[str], shards: int) -> DataFrame:
    """fault, n over a run's shards: keys in several shards, repeated keys, missing shards, and contract columns with several values."""
    keyed = rows.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(shard).alias("s")).agg(F.count_if(F.col("s") > 1).alias("keys in several shards"), F.count_if((F.col("n") > 1) & (F.col("s") == 1)).alias("repeated keys"))
    values = [F.count_distinct(F.to_json(F.struct(c))).alias(f"values of {c}") for c in contract]
    whole = rows.agg((F.lit(shards) - F.countDistinct(shard)).alias("missing shards"), *values)
    one = keyed.crossJoin(F.broadcast(whole))  # one row each
    listed = F.array(*(F.struct(F.lit(c).alias("fault"), (F.col(f"`{c}`") - (1 if c.startswith("values of ") else 0)).cast("long").alias("n")) for c in one.columns))
    return one.select(F.explode(listed).alias("x")).select("x.*").filter("n > 0")
