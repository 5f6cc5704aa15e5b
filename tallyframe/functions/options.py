"""Options' probabilities from tokens' scores, and what is said of options by letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound


def grouped_probabilities(scores: Column, tokens: dict[str, list[int]]) -> Column:
    """A map from letter to probability: the scores of each letter's tokens (places in ``scores``) added up, then set to a sum of one.

    Sums are taken against their greatest term, so large scores do not
    overflow.  Places beyond the list, null and NaN scores do not count; a
    letter without a score is left out, and without any letter, or scores, the
    map is empty.
    """

    def log_sum(values: Column) -> Column:
        return bound(F.array_max(values), lambda peak: peak + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - peak))))

    def entry(letter: str, ids: list[int]) -> Column:
        own = F.filter(F.array(*(F.get(scores, F.lit(i)).cast("double") for i in ids)), lambda v: v.isNotNull() & ~F.isnan(v))
        return F.when(F.size(own) > 0, F.struct(F.lit(letter).alias("key"), log_sum(own).alias("value")))

    def normal(entries: Column) -> Column:
        total = log_sum(F.transform(entries, lambda e: e["value"]))
        return bound(total, lambda t: F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.exp(e["value"] - t)))))

    found = F.array_compact(F.array(*(entry(letter, ids) for letter, ids in tokens.items())))
    return bound(found, lambda e: F.when(F.size(e) > 0, normal(e)).otherwise(F.create_map().cast("map<string,double>")))


def best_key(values: Column) -> Column:
    """The key with the greatest value, the least of equal ones; null for an empty map."""
    return F.array_min(F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))["k"]


def log_gap(a: Column, b: Column, least: float = 1e-12) -> Column:
    """ln a - ln b, both held above ``least``."""
    return F.log(F.greatest(a, F.lit(least))) - F.log(F.greatest(b, F.lit(least)))


# How an option is spoken of by its letter.
_REFERENCE = r"(?i)\b(?:option|choice|answer)\s+([A-D])\b"


def without_letters(text: Column, options: Column) -> Column:
    """(text, n): "option B" and the like replaced by the option's own words, and how often; a letter without an option stays."""

    def one(acc: Column, i: Column) -> Column:
        letter = F.char(i + 65)
        pattern = F.concat(F.lit(r"(?i)\b(?:option|choice|answer)\s+"), letter, F.lit(r"\b"))
        words = F.concat(F.lit('the answer "'), F.regexp_replace(F.trim(F.get(options, i)), r"\.+$", ""), F.lit('"'))
        safe = F.regexp_replace(words, r"([\\$])", r"\\$1")  # no group of the pattern is meant
        return F.struct(F.regexp_replace(acc["text"], pattern, safe).alias("text"), (acc["n"] + F.regexp_count(acc["text"], pattern)).alias("n"))

    return F.aggregate(F.sequence(F.lit(0), F.least(F.lit(4), F.size(options)) - 1), F.struct(text.alias("text"), F.lit(0).alias("n")), one)
