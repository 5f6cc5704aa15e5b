"""Controls and repairs of a sample's spans: arrays of (s, e), as Column expressions.

A sample has few spans, so arrays are the right shape here; spans of whole
groups are rows (see :mod:`.intervals`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("double").alias("s"), e.cast("double").alias("e"))


def total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, x: a + (x["e"] - x["s"]))


def merged(spans: Column, touch: float = 1e-9) -> Column:
    """The union of spans, those within ``touch`` joined, in order."""
    start = F.slice(F.array_sort(spans), 1, 1)
    rest = F.slice(F.array_sort(spans), 2, F.greatest(F.size(spans), F.lit(1)))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["s"], F.greatest(last["e"], x["e"]))))
        return F.when(x["s"] <= last["e"] + touch, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(rest, start, step)


def clipped(spans: Column, least: float, places: int = 3) -> Column:
    """Spans whose overlaps are cut off at the end of the one before; what is left below ``least`` goes."""

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(x["s"], F.coalesce(F.element_at(F.transform(acc, lambda y: y["e"]), -1), x["s"]))
        one = span(F.round(begin, places), F.round(x["e"], places))
        return F.when(one["e"] - one["s"] < least, acc).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<s:double,e:double>>"), lambda acc, x: F.when(F.size(acc) == 0, F.when(x["e"] - x["s"] < least, acc).otherwise(F.array(span(F.round(x["s"], places), F.round(x["e"], places))))).otherwise(step(acc, x)))


def jittered(spans: Column, kind: str, share: float, duration: Column) -> Column:
    """Spans changed by a share of their length (expand, shrink, left, right), kept inside [0, duration]; empty ones go."""
    low, high = {"expand": (-share / 2, share / 2), "shrink": (share / 2, -share / 2), "left": (-share, -share), "right": (share, share)}[kind]
    moved = F.transform(spans, lambda x: span(F.greatest(F.lit(0.0), x["s"] + low * (x["e"] - x["s"])), F.least(duration, x["e"] + high * (x["e"] - x["s"]))))
    return F.filter(moved, lambda x: x["s"] < x["e"])


def hull(spans: Column) -> Column:
    """The one span around all of them; null without spans."""
    return F.when(F.size(spans) > 0, span(F.array_min(F.transform(spans, lambda x: x["s"])), F.array_max(F.transform(spans, lambda x: x["e"]))))


def evenly_placed(spans: Column, duration: Column) -> Column:
    """As many spans of the same lengths in the same order, with equal gaps around them; null where they do not fit."""
    gap = (duration - total(spans)) / (F.size(spans) + 1)
    before = lambda i: total(F.slice(spans, F.lit(1), i))
    placed = F.transform(spans, lambda x, i: span(gap * (i + 1) + before(i), gap * (i + 1) + before(i) + x["e"] - x["s"]))
    return F.when(gap >= 0, placed)


def same(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    close = F.zip_with(a, b, lambda x, y: (F.abs(x["s"] - y["s"]) <= tolerance) & (F.abs(x["e"] - y["e"]) <= tolerance))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda c: F.coalesce(c, F.lit(False)))


def problem(spans: Column, duration: Column, most: int = 16) -> Column:
    """The first fault of a list of spans, null if it has none."""
    later = F.zip_with(spans, F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), lambda x, y: y["s"] < x["e"])
    return (
        F.when(spans.isNull() | (F.size(spans) == 0), "no span").when(F.size(spans) > most, "too many spans")
        .when(F.exists(spans, lambda x: x["s"].isNull() | x["e"].isNull() | F.isnan(x["s"]) | F.isnan(x["e"])), "not a number").when(F.exists(spans, lambda x: x["s"] >= x["e"]), "not rising")
        .when(F.exists(spans, lambda x: (x["s"] < 0) | (x["e"] > duration)), "outside").when(F.exists(later, lambda c: F.coalesce(c, F.lit(False))), "overlap or order")
    )


def window(s: Column, e: Column, least: float, most: float, duration: Column) -> Column:
    """A view's window: extended forward to ``least``, moved back where the end is passed, cut to ``most``."""
    length = F.least(F.greatest(e - s, F.lit(least)), F.lit(most), duration)
    begin = F.greatest(F.lit(0.0), F.least(s, duration - length))
    return span(begin, begin + length)


def remapped(spans: Column, pieces: Column) -> Column:
    """Spans of a montage in the times of its sources: ``pieces`` are (s, e, at), [s, e) of the montage from ``at`` on."""
    cut = F.transform(spans, lambda x: F.transform(pieces, lambda p: span(F.greatest(x["s"], p["s"]) - p["s"] + p["at"], F.least(x["e"], p["e"]) - p["s"] + p["at"])))
    return F.filter(F.flatten(cut), lambda x: x["s"] < x["e"])


def neighbours_overlap(spans: Column) -> Column:
    """Whether a span begins before the one before it ends, in order of their starts."""
    ordered = F.array_sort(spans)
    return F.exists(F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda x, y: F.coalesce(x["e"] > y["s"], F.lit(False))), lambda c: c)


def spread(n: Column, k: int) -> Column:
    """``k`` indices from 0 to n - 1 at equal steps, halves to the even one."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / max(1, k - 1)).cast("int"))


def even_floor(x: Column) -> Column:
    """The greatest even number that is no larger, 2 at least."""
    return F.greatest(F.lit(2), F.floor(x / 2) * 2).cast("long")


def even_ceil(x: Column) -> Column:
    return (F.ceil(x / 2) * 2).cast("long")
