"""Readers and writers of loosely structured records under explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows under ``schema`` and, with the line as one more column, those that do not parse."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull())


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_of(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first non-null of those columns that ``df`` has, else the default."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have, *([default] if default is not None else [])) if have or default is not None else F.lit(None)


def accepted(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows no rule rejects, and the others with the first rule's name as their reason."""
    reason = F.coalesce(*(F.when(F.coalesce(rule, F.lit(True)), name) for name, rule in reasons.items()))
    marked = df.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def write_json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
