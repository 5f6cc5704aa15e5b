"""A corpus pipeline of the training-data operators, stage by stage.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame;
its output is written as Parquet and read again as the next stage's documents.
Stages work on whichever rows they are given: empty tables stay empty, null
and empty texts pass through, and columns of the input beyond a stage's own
are kept or, in the last stage, left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, copies, decontaminate, line_dedup, shingle_join, toxicity
from tallyframe.llm.registry import fold
from tallyframe.llm.session import materialize, small

#: Rejected documents up to which their keys are broadcast (some 16 bytes each).
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, keys: DataFrame, text_hash: Column) -> DataFrame:
    """``docs`` without the rows of ``keys`` (doc_id, th: ``text_hash`` as the operator that made them takes it); null ids are compared as values."""
    keyed = docs.withColumn("__th", text_hash)
    keys = materialize(keys.select(F.col("doc_id").alias("__id"), F.col("th").alias("__t")).distinct())
    return keyed.join(small(keys, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t")), "left_anti").drop("__th")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, labels, fold(4) != 2, keep=tuple(docs.columns), score_col="__score")
    return scored.filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated long lines; n_chars follows the text, a text without lines left stays as an empty one."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(1).alias("__one"), *others).alias("__doc")))
    changed = F.col("n_dropped") > 0
    columns = {c: F.col(f"__doc.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; documents without words all stay, and so do rows with a null id and rows that repeat the id that stays."""
    groups = shingle_join.join_classes(docs)
    return _without(docs, groups.filter("component_id IS NOT NULL AND id <> component_id").select(F.col("id").alias("doc_id"), "th"), copies.text_hash("text"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"), decontaminate.text_hash("text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return bpe.digests(bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id")


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_once),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE", encoded),
]

#: The first and the last stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
