"""Views of one sample against an anchor view, and inputs for judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def against_anchor(rows: DataFrame, key: str, view: str, prediction: str, gold: str, anchor: str, by: list[str] | None = None) -> DataFrame:
    """by, view, n, valid, correct, accuracy, changed, improved, harmed, delta: every view against the anchor on samples that hold it.

    valid: rows with a prediction and a gold answer; accuracy is over these,
    and so is delta against the anchor's own accuracy on the same samples'
    anchor rows (all of the group's).  changed: another prediction than the
    anchor's, improved and harmed: from wrong to right and back, an unread
    prediction being wrong.  The anchor's row goes to all rows of its sample
    by one aggregation and a join on the key; one row per sample and view is
    assumed.
    """
    by = by or []
    base = rows.filter(F.col(view) == anchor).select(F.col(key).alias("__k"), F.col(prediction).alias("__p"), F.lit(True).alias("__there"))
    both = rows.join(base, rows[key] == F.col("__k"))
    known = F.col(gold).isNotNull()
    right, was = (F.coalesce(F.col(c) == F.col(gold), F.lit(False)) for c in (prediction, "__p"))
    valid = F.col(prediction).isNotNull() & known
    rate = lambda ok, of: F.count_if(ok & of) / F.nullif(F.count_if(of), F.lit(0))
    out = both.groupBy(*by, view).agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_if(right & valid).alias("correct"), rate(right, valid).alias("accuracy"),
        F.count_if(~F.col(prediction).eqNullSafe(F.col("__p"))).alias("changed"), F.count_if(known & right & ~was).alias("improved"), F.count_if(known & was & ~right).alias("harmed"),
        rate(was, F.col("__p").isNotNull() & known).alias("__anchor"),
    )
    return out.withColumn("delta", F.col("accuracy") - F.col("__anchor")).drop("__anchor")


def judge_inputs(rows: DataFrame, key: str, question: Column, reference: Column, answer: Column) -> DataFrame:
    """key, pass (0, 1), source: what a judge is given, once with the reference first and once with the answer first, under an id that tells nothing."""
    item = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 20)
    first = F.to_json(F.struct(item.alias("item"), question.alias("question"), reference.alias("reference"), answer.alias("candidate")))
    second = F.to_json(F.struct(item.alias("item"), question.alias("question"), answer.alias("candidate"), reference.alias("reference")))
    return rows.select(key, F.posexplode(F.array(first, second)).alias("pass", "source"))


def calibration(rows: DataFrame, category: str, expected: str, verdict: str) -> DataFrame:
    """category, n, resolved, right, accuracy, false_yes, false_no of verdicts (null: unresolved) on cases whose answer is known."""
    e, v = F.col(expected), F.col(verdict)
    return rows.groupBy(category).agg(
        F.count("*").alias("n"), F.count(v).alias("resolved"), F.count_if(e == v).alias("right"), (F.count_if(e == v) / F.count("*")).alias("accuracy"), F.count_if(v & ~e).alias("false_yes"), F.count_if(e & ~v).alias("false_no")
    )
