"""Live progress of runs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Work-unit rows as their files arrive; torn lines are left out."""
    schema = "unit string, view string, status string, correct boolean, at timestamp, _corrupt_record string"
    return spark.readStream.schema(schema).json(path).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def snapshot(units: DataFrame) -> DataFrame:
    """Progress by view: rows, complete, failed, accuracy of what is judged (complete mode)."""
    return units.groupBy("view").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def windowed(units: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows by view and tumbling window, closed once the watermark has passed (append mode)."""
    return units.withWatermark("at", late).groupBy(F.window("at", width), "view").agg(F.count("*").alias("n")).select("view", F.col("window.start").alias("start"), "n")


def changes(units: DataFrame) -> DataFrame:
    """A unit's status each time it differs from the last one seen (append mode); rows older than that one are late and change nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, newest = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")  # chunks of one trigger come in no order
        for r in rows.itertuples(index=False):
            at = r.at.value // 1000
            if newest is not None and at < newest:
                continue  # an earlier trigger has seen a later status
            newest = at
            if r.status != last:
                out.append((key[0], last, r.status))
                last = r.status
        state.update((last, newest))
        yield pd.DataFrame(out, columns=["unit", "before", "status"])

    return units.filter("at IS NOT NULL").select("unit", "status", "at").groupBy("unit").applyInPandasWithState(step, "unit string, before string, status string", "last string, newest long", "append", GroupStateTimeout.NoTimeout)
