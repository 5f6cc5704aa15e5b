"""Tables in the folder that driver and executors share, to cut lineage without tying results to an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under spark.checkpoint.dir and read back: later jobs see the same rows in the same files.

    Where the setting is missing, a temporary folder serves a session whose
    tasks run in this process; elsewhere that is an error.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/tallyframe-stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
