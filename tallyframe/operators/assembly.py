"""Sets of samples put together: arms, paths, precedence, differences, fills, and figures over their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_list(*lists: Column) -> Column:
    """The first of some arrays that holds anything; null if none does."""
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))


def within_cap(duration: Column, cap: float) -> Column:
    """Whether a duration is within a cap; a cap of 0 keeps all."""
    return duration <= cap if cap else F.lit(True)


def arms(df: DataFrame, shared: list[str], specs: dict[str, dict[str, Column]]) -> DataFrame:
    """A row for each arm: the shared columns, arm, and the arm's own columns (null where it has none of that name)."""
    own = list(dict.fromkeys(name for spec in specs.values() for name in spec))
    rows = [F.struct(F.lit(arm).alias("arm"), *(spec.get(name, F.lit(None)).alias(name) for name in own)) for arm, spec in specs.items()]
    return df.select(*shared, F.inline(F.array(*rows)))


def unlike_arms(df: DataFrame, key: list[str], inputs: list[str], expected: int) -> DataFrame:
    """Keys whose arms do not share their inputs, or are not as many as expected: key, n_arms, n_inputs."""
    counts = df.groupBy(*key).agg(F.count_distinct("arm").alias("n_arms"), F.count_distinct(F.to_json(F.struct(*inputs))).alias("n_inputs"))
    return counts.filter((F.col("n_inputs") != 1) | (F.col("n_arms") != expected))


def rewritten(df: DataFrame, column: str, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` with values replaced by ``mapping`` (old, new), and missing: whether it had none.

    A missing one stays as it was, or with ``strict`` fails the job.
    """
    known = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")).dropDuplicates(["__old"])
    out = df.join(known, F.col(column) == F.col("__old"), "left").withColumn("missing", F.col("__old").isNull() & F.col(column).isNotNull())
    if strict:
        out = out.withColumn("missing", F.when(F.col("missing"), F.raise_error(F.concat(F.lit("no entry for "), F.col(column).cast("string"))).cast("boolean")).otherwise(False))
    return out.withColumn(column, F.when(F.col("__old").isNull(), F.col(column)).otherwise(F.col("__new"))).drop("__old", "__new")


def by_position(**lists: Column) -> Column:
    """Structs of the lists' values at each position; null if the lists differ in length."""
    sizes = [F.size(x) for x in lists.values()]
    alike = reduce(lambda a, b: a & b, (s == sizes[0] for s in sizes), F.lit(True))
    return F.when(alike, F.arrays_zip(*(x.alias(n) for n, x in lists.items())))


def delta(current: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, before, change: what a stored comparison row has for the same keys; new keys are left out."""
    return current.select(*keys, value).join(stored.select(*keys, F.col(value).alias("before")), keys).withColumn("change", F.col(value) - F.col("before"))


def difference(whole: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows of ``whole`` that are not in ``part``; raises if ``part`` has keys outside of it or is all of it."""
    outside = part.join(whole, key, "left_anti").select(key).limit(1).collect()
    if outside:
        raise ValueError(f"{outside[0][0]!r} is not in the whole")
    rest = whole.join(part, key, "left_anti")
    if rest.isEmpty():
        raise ValueError("nothing is left of the whole")
    return rest


def by_precedence(sources: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """For each key the row of the first source that has it (its first by ``order``), and source: that one's place.

    Sources have the same columns.
    """
    ranked = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), ranked)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("source", order)).alias("__row")).select(*key, "__row.*")


def filled(df: DataFrame, decisions: DataFrame, key: list[str], value: str) -> DataFrame:
    """``df`` with nulls of a column filled by ``decisions`` (key, value, reason, reviewer: one for a key), and adjudication.

    That is filled, or why a decision was refused: already decided, no reason, no reviewer; null without one.
    """
    d = decisions.select(*key, F.col(value).alias("__value"), F.col("reason").alias("__reason"), F.col("reviewer").alias("__reviewer"), F.lit(True).alias("__there"))
    out = df.join(d, key, "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    state = F.when(F.col("__there"), F.when(F.col(value).isNotNull(), "already decided").when(blank("__reason"), "no reason").when(blank("__reviewer"), "no reviewer").otherwise("filled"))
    out = out.withColumn("adjudication", state)
    return out.withColumn(value, F.when(F.col("adjudication") == "filled", F.col("__value")).otherwise(F.col(value))).drop("__value", "__reason", "__reviewer", "__there")


def expanded_out(samples: DataFrame, quarantined: DataFrame, unit: str) -> DataFrame:
    """Samples without those of a quarantined unit: a unit's entry drops all its samples, null units stay."""
    return samples.join(quarantined.select(unit).distinct(), unit, "left_anti")


def complementarity(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Which of two views is right: both, only the one or the other, or none; null if either is unknown."""
    return F.when(a & b, "both").when(a & ~b, f"{names[0]}_only").when(~a & b, f"{names[1]}_only").when(~a & ~b, "both_wrong")


def answer_summary(df: DataFrame, by: list[str], prediction: str, correct: str, ratio: str) -> DataFrame:
    """total, parsed, failures, correct, accuracy, parse_rate and a ratio's least, mean and greatest for each group."""
    n, parsed = F.count("*"), F.count(prediction)
    right = F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    return df.groupBy(*by).agg(
        n.alias("total"), parsed.alias("parsed"), (n - parsed).alias("failures"), right.alias("correct"), (right / n).alias("accuracy"), (parsed / n).alias("parse_rate"),
        F.min(ratio).alias("ratio_min"), F.avg(ratio).alias("ratio_mean"), F.max(ratio).alias("ratio_max"),
    )


def sufficiency(df: DataFrame, by: list[str], intervals: Column, any_correct: Column) -> DataFrame:
    """Statuses counted for each group, and the share of sufficient ones among those that were checked."""
    yes = F.coalesce(any_correct, F.lit(False))
    some = F.coalesce(intervals, F.lit(0)) > 0
    good, bad = F.count_if(yes), F.count_if(~yes & some)
    return df.groupBy(*by).agg(good.alias("sufficient"), bad.alias("insufficient"), F.count_if(~yes & ~some).alias("skipped"), F.try_divide(good, good + bad).alias("rate"))


def liveness(beats: DataFrame, by: list[str], at: str, now: Column, stale: float) -> DataFrame:
    """Each worker's beats, last_at, age in seconds at ``now``, and whether it is stale."""
    out = beats.groupBy(*by).agg(F.count("*").alias("beats"), F.max(at).alias("last_at"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 1_000_000
    return out.withColumn("age", age).withColumn("stale", F.col("age") > stale)


def numeric_part(name: Column) -> Column:
    """The last number in a name, by which s2 comes before s10; null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).try_cast("long")
