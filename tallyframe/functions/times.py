"""Times and time spans in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound

_CLOCK = r"\d+(?::\d+){0,2}(?:\.\d+)?"
_PAIR = rf"({_CLOCK})\s*[-–—]\s*({_CLOCK})"


def seconds(text: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS, each with a fraction or not; null if a part is no number."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def strict_seconds(text: Column) -> Column:
    """Seconds of MM:SS or HH:MM:SS with parts below sixty after the first; null for anything else."""
    return F.when(F.regexp_like(text, F.lit(r"^\d{1,6}(:[0-5]\d){1,2}(\.\d+)?$")), seconds(text))


def read_ranges(text: Column, duration: Column | None = None) -> Column:
    """(spans, alone): the time ranges (s, e) of a text that rise, sorted, and whether it holds such ranges and separators alone, all inside the duration.

    The text is searched once; its matches are split at their dash.
    """

    def read(found: Column) -> Column:
        halves = F.transform(found, lambda x: F.split(x, "[-–—]"))
        spans = F.transform(halves, lambda h: F.struct(seconds(h[0]).alias("s"), seconds(h[1]).alias("e")))
        return bound(F.array_sort(F.filter(spans, lambda x: x["s"] < x["e"])), lambda x: judged(x, found))

    def judged(spans: Column, found: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(text, _PAIR, ""), r"[\s,;\[\]()]", "")
        inside = F.lit(True) if duration is None else F.forall(spans, lambda x: x["e"] <= duration)
        whole = (F.size(found) > 0) & (F.size(spans) == F.size(found))
        return F.struct(spans.alias("spans"), F.when(whole, (rest == "") & inside).otherwise(False).alias("alone"))

    return bound(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(0)), read)


def ranges(text: Column) -> Column:
    """Spans (s, e) of all time ranges in a text, those that do not rise left out, sorted."""
    return read_ranges(text)["spans"]


def only_ranges(text: Column, duration: Column) -> Column:
    """The spans of a text that holds ranges and separators alone, all rising and inside the duration; else null."""
    return bound(read_ranges(text, duration), lambda r: F.when(r["alone"], r["spans"]))


def around(at: Column, radius: float, duration: Column) -> Column:
    """The span of a point, widened by a radius and kept inside [0, duration]."""
    return F.struct(F.greatest(F.lit(0.0), at - radius).alias("s"), F.least(duration, at + radius).alias("e"))


def eta_hours(done: Column, total: Column, started: Column, now: Column) -> Column:
    """Hours left at the pace so far; null before anything is done."""
    took = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 3_600_000_000
    return F.when(done > 0, took / done * (total - done))
