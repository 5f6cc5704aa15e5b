"""Repair of submitted spans, step by step, with a log of what was changed.

Spans come as arrays of (s, e, note) in the order of their submission, a few a
row.  Each step is an ordered fold that carries the spans so far, what is left
of the budget and the log, so that a repair can be read back from its entries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import bound

_SPANS = "array<struct<s:double,e:double,note:string>>"
_LOG = "array<struct<kind:string,s:double,e:double,to_s:double,to_e:double,n:int>>"
#: Differences below this are none.
NEAR = 1e-6


def _span(s: Column, e: Column, note: Column) -> Column:
    return F.struct(s.cast("double").alias("s"), e.cast("double").alias("e"), note.alias("note"))


def _entry(kind: str, s=None, e=None, to_s=None, to_e=None, n=None) -> Column:
    value = lambda x, t: F.lit(x).cast(t) if not isinstance(x, Column) else x.cast(t)
    return F.struct(F.lit(kind).alias("kind"), *(value(x, "double").alias(a) for x, a in ((s, "s"), (e, "e"), (to_s, "to_s"), (to_e, "to_e"))), value(n, "int").alias("n"))


def _add(log: Column, when: Column, entry: Column) -> Column:
    return F.when(when, F.concat(log, F.array(entry).cast(_LOG))).otherwise(log)


def _length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, x: a + (x.e - x.s))


def budget(duration: Column, share: float = 0.5, most: float | Column = float("inf"), wide: Column | None = None, wide_share: float = 1.0) -> Column:
    """Seconds that all spans together may take: a share of the duration, larger for ``wide`` tasks, and no more than ``most``."""
    rate = F.lit(share) if wide is None else F.when(F.coalesce(wide, F.lit(False)), max(share, wide_share)).otherwise(share)
    return F.least(most if isinstance(most, Column) else F.lit(most), rate * duration)


def _fitted(spans: Column, duration: Column, least: float) -> Column:
    """(spans, log): each clamped to [0, duration]; empty ones go, short ones grow to ``least`` around their middle."""

    def step(acc: Column, x: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), F.least(duration, x.s)), F.greatest(F.lit(0.0), F.least(duration, x.e))

        def place(c: Column) -> Column:
            short = c.high - c.low < least - NEAR
            begin = F.greatest(F.lit(0.0), c.low - (least - (c.high - c.low)) / 2)
            end = F.least(duration, begin + least)
            begin = F.greatest(F.lit(0.0), end - least)
            return F.struct(c.low.alias("low"), c.high.alias("high"), short.alias("short"), F.when(short, begin).otherwise(c.low).alias("s"), F.when(short, end).otherwise(c.high).alias("e"))

        def keep(p: Column) -> Column:
            log = _add(acc.log, p.short, _entry("expanded short", p.low, p.high, p.s, p.e))
            log = _add(log, (F.abs(p.s - x.s) > 1e-9) | (F.abs(p.e - x.e) > 1e-9), _entry("clamped", x.s, x.e, p.s, p.e))
            empty = F.struct(acc.spans.alias("spans"), _add(acc.log, F.lit(True), _entry("dropped empty", x.s, x.e)).alias("log"))
            return F.when(p.high <= p.low, empty).otherwise(F.struct(F.concat(acc.spans, F.array(_span(p.s, p.e, x.note))).alias("spans"), log.alias("log")))

        return bound(bound(F.struct(low.alias("low"), high.alias("high")), place), keep)

    return F.aggregate(spans, F.struct(F.array().cast(_SPANS).alias("spans"), F.array().cast(_LOG).alias("log")), step)


def _counted(state: Column, most: int) -> Column:
    """(spans, log) with the first ``most`` spans."""
    extra = F.size(state.spans) - most
    return F.struct(F.slice(state.spans, 1, most).alias("spans"), _add(state.log, extra > 0, _entry("dropped extra", n=extra)).alias("log"))


def _split(state: Column, allowed: Column, most: int) -> Column:
    """(spans, log): a span that alone exceeds the budget becomes pieces over its whole range, so that head and tail stay."""

    def step(acc: Column, x: Column) -> Column:
        length, held = x.e - x.s, F.size(state.spans)
        pieces = F.greatest(F.lit(2), F.least(F.lit(most + 1) - held, F.ceil(length / allowed).cast("int")))
        one = allowed / pieces
        parts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: bound(x.s + (length - one) * i / (pieces - 1), lambda b: _span(b, b + one, x.note)))
        divide = (length > allowed + NEAR) & (held + F.size(acc.spans) < most) & (allowed > 0)
        return F.struct(F.concat(acc.spans, F.when(divide, parts).otherwise(F.array(_span(x.s, x.e, x.note)))).alias("spans"), _add(acc.log, divide, _entry("split to cover", x.s, x.e, n=pieces)).alias("log"))

    done = F.aggregate(state.spans, F.struct(F.array().cast(_SPANS).alias("spans"), state.log.alias("log")), step)
    cut = bound(done, lambda d: F.struct(F.slice(d.spans, 1, most).alias("spans"), d.log.alias("log")))
    return F.when(_length(state.spans) > allowed + NEAR, cut).otherwise(state)


def _trimmed(state: Column, allowed: Column, least: float) -> Column:
    """(spans, log): spans in turn as long as the budget lasts; the one that exceeds it is cut if ``least`` remains, later ones go."""
    begin = F.struct(F.array().cast(_SPANS).alias("spans"), state.log.alias("log"), allowed.cast("double").alias("left"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = x.e - x.s <= acc.left + NEAR
        cut = ~fits & (acc.left >= least - NEAR)
        spans = F.when(fits, F.concat(acc.spans, F.array(_span(x.s, x.e, x.note)))).when(cut, F.concat(acc.spans, F.array(_span(x.s, x.s + acc.left, x.note)))).otherwise(acc.spans)
        after = F.struct(spans.alias("spans"), _add(acc.log, cut, _entry("trimmed", x.s, x.e, x.s, x.s + acc.left)).alias("log"), F.when(fits, acc.left - (x.e - x.s)).otherwise(0.0).alias("left"), fits.alias("open"))
        return F.when(acc.open, after).otherwise(acc)

    total = _length(state.spans)
    kept = bound(F.aggregate(state.spans, begin, step), lambda k: F.struct(k.spans.alias("spans"), _add(k.log, F.lit(True), _entry("enforced budget", total, _length(k.spans), allowed)).alias("log")))
    return F.when(total > allowed + NEAR, kept).otherwise(state)


def _inside(spans: Column, duration: Column) -> Column:
    """Spans in whole milliseconds that never leave them: starts rounded up, ends down."""
    end = lambda x: F.floor((x + 1e-9) * 1000) / 1000
    start = lambda x: F.greatest(F.lit(0.0), F.ceil((x - 1e-9) * 1000) / 1000)
    return F.transform(spans, lambda x: _span(start(x.s), F.greatest(start(x.s), F.least(end(x.e), end(duration))), x.note))


def repaired(spans: Column, duration: Column, allowed: Column, least: float = 1.0, most: int = 4) -> Column:
    """(spans, log, fault) of submitted spans (s, e, note): inside the duration, ``least`` long, ``most`` of them, ``allowed`` seconds in all.

    Faults are not repaired: no list (null), no numbers (a null or non-finite
    limit, or duration), no note, nothing left.  Spans are null with a fault;
    the log tells what happened before it.  An empty list is no fault.  Log
    entries: kind, the span before (for a budget: seconds before and after,
    and the budget), after, and a number.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fault = (
        F.when(spans.isNull(), "no list").when(F.exists(spans, lambda x: ~(number(x.s.cast("double")) & number(x.e.cast("double")))) | ~F.coalesce(number(duration.cast("double")), F.lit(False)), "no numbers")
        .when(F.exists(spans, lambda x: F.trim(F.coalesce(x.note, F.lit(""))) == ""), "no note")
    )
    empty = F.struct(F.lit(None).cast(_SPANS).alias("spans"), F.array().cast(_LOG).alias("log"), fault.alias("fault"))
    typed = F.transform(spans, lambda x: _span(x.s, x.e, x.note))
    state = bound(bound(_fitted(typed, duration, least), lambda s: _counted(s, most)), lambda s: _split(s, allowed, most))
    done = bound(
        bound(state, lambda s: _trimmed(s, allowed, least)),
        lambda s: F.struct(F.when((F.size(s.spans) > 0) | (F.size(spans) == 0), _inside(s.spans, duration)).alias("spans"), s.log.alias("log"), F.when((F.size(s.spans) == 0) & (F.size(spans) > 0), "nothing left").alias("fault")),
    )
    return F.when(fault.isNull(), done).otherwise(empty)
