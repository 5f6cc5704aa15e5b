"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Probabilities of an array of log-scores, shifted by their greatest."""
    most = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - most))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def entropy(p: Column) -> Column:
    """Entropy of a distribution, over that of the uniform one."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0)) / F.log(F.size(p).cast("double"))


def steady_mean(x: Column) -> Column:
    """An aggregate: the mean of numbers, hardly a bit of which hangs on the order in which rows are added.

    Multiples of 2^-20 add up without rounding (to some 10^9), and what is
    left of each number is too small for its roundings to show in the sum.
    """
    x = x.cast("double")
    near = F.abs(x) < 2.0**33  # not NaN, infinities and numbers without such a rest
    high = F.when(near, F.rint(x * 2.0**20) / 2.0**20).otherwise(x)
    return (F.sum(high) + F.coalesce(F.sum(F.when(near, x - high)), F.lit(0.0))) / F.nullif(F.count(x), F.lit(0))


def margin(p: Column) -> Column:
    """The greatest probability less the next."""
    s = F.sort_array(p, asc=False)
    return s[0] - s[1]


def bucket(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge above ``x``; one label more than edges; null stays null."""
    out = F.when(x < edges[0], labels[0])
    for e, name in zip(edges[1:], labels[1:]):
        out = out.when(x < e, name)
    return out.when(x.isNotNull(), labels[-1])


def issues(rules: dict[str, Column]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_hashes(hashes: Column, n: int, use: Callable[[Column], Column]) -> Column:
    """``use`` of the hashes of every run of ``n`` entries: runs of twice the length are made of two, so each entry is hashed log n times."""

    def joined(a: Column, b: Column, apart: int) -> Column:
        size = F.greatest(F.lit(0), F.size(b) - apart)
        return F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(apart + 1), size), lambda x, y: F.xxhash64(x, y))

    def grow(whole: Column | None, done: int, power: Column, width: int, left: int) -> Column:
        if left & 1:
            if left == 1:
                return use(power if whole is None else joined(whole, power, done))
            step = lambda w: bound(joined(power, power, width), lambda p: grow(w, done + width, p, 2 * width, left >> 1))
            return step(power) if whole is None else bound(joined(whole, power, done), step)
        return bound(joined(power, power, width), lambda p: grow(whole, done, p, 2 * width, left >> 1))

    return bound(hashes, lambda h: grow(None, 0, h, 1, n))


def repeated_ngrams(text: Column, n: int = 20) -> Column:
    """1 - distinct / all n-word runs of the text's words; null below n words.

    Words are found and hashed once; runs are told apart by 64-bit hashes made
    of those of shorter runs, so that none is built as a text and the distinct
    ones are found by a hash set.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    return run_hashes(F.transform(words, lambda w: F.xxhash64(w)), n, lambda runs: bound(runs, lambda r: F.when(F.size(r) > 0, 1 - F.size(F.array_distinct(r)) / F.size(r))))


def first_rule(text: Column, rules: dict[str, list[str]], other: str) -> Column:
    """The first category one of whose phrases is in the text."""
    out = None
    for name, phrases in rules.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(text, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)
