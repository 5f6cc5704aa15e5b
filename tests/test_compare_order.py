"""Common draws against numpy, places and batches, farthest points, overlaps and exact tests against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyframe.operators import compare, farthest, intervals, metrics, order, splits


def test_common_draws_equal_numpy(spark):
    r = random.Random(4)
    rows = [(f"c{r.randrange(12)}" if i % 40 else None, r.choice(["x", "y"]) if i % 30 else None, arm, None if r.random() < 0.1 else float(r.random() < 0.3 + 0.1 * k)) for i in range(200) for k, arm in enumerate("pqr")]
    rows += [("c1", "x", "other", 1.0)]
    df = spark.createDataFrame(rows, "c string, g string, arm string, v double").repartition(3)
    contrasts = {"gain": {"q": 1, "p": -1}, "bend": {"r": 1, "q": -2, "p": 1}, "lost": {"z": 1, "p": -1}}
    got = {(x.dimension, x.group, x.name): x for x in compare.compared(df, "c", "arm", "v", ["p", "q", "r", "z"], contrasts, ["g"], draws=300, seed=7).collect()}
    names = sorted({x[0] for x in rows}, key=str)
    seeds = {x.c: x.h for x in spark.createDataFrame([(n,) for n in names], "c string").select("c", F.xxhash64(F.lit(7), F.coalesce("c", F.lit("")), F.col("c").isNull()).alias("h")).collect()}
    weights = compare.cluster_weights(np.array([seeds[n] for n in names]), 300)
    for dimension, group in [("overall", "all"), ("g", "x"), ("g", "y"), ("g", "unknown")]:
        mine = [x for x in rows if dimension == "overall" or (x[1] or "unknown") == group]
        means, points, counts = {}, {}, {}
        for arm in "pqr":
            s, n = (np.array([sum(f(x[3]) for x in mine if x[0] == c and x[2] == arm) for c in names]) for f in (lambda v: v or 0.0, lambda v: v is not None))
            means[arm], points[arm], counts[arm] = (s @ weights) / np.where(n @ weights, n @ weights, np.nan), s.sum() / n.sum(), n.sum()
        for name, w in {**{a: {a: 1} for a in "pqr"}, "gain": contrasts["gain"], "bend": contrasts["bend"]}.items():
            x = got[dimension, group, name]
            draws = sum(k * means[a] for a, k in w.items())
            assert x.n == sum(counts[a] for a in w) and math.isclose(x.estimate, sum(k * points[a] for a, k in w.items()), abs_tol=1e-12)
            low, high = np.percentile(draws[~np.isnan(draws)], [2.5, 97.5])
            assert math.isclose(x.low, low, abs_tol=1e-9) and math.isclose(x.high, high, abs_tol=1e-9)
        lost = got[dimension, group, "lost"]
        assert lost.estimate is None and lost.low is None
    # The same arm on both sides differs by nothing in every draw, which separate draws would not give.
    same = compare.compared(df, "c", "arm", "v", ["p"], {"none": {"p": 0}}, draws=50).filter("name = 'none'").first()
    assert (same.estimate, same.low, same.high) == (0.0, 0.0, 0.0)
    assert compare.compared(df.limit(0), "c", "arm", "v", ["p"], {}, draws=5).count() == 0


def test_places_and_batches(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", None]) if i % 3 else "a", r.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, g string, x int").repartition(5)
    got = {x.i: x.position for x in order.positions(df, ["x", "i"]).collect()}
    assert got == {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda t: (t[2], t[0])))}
    by = {x.i: x.p for x in order.positions(df, [F.desc("x"), "i"], ["g"], "p").collect()}
    for g in ("a", "b", None):
        assert {i: by[i] for i, h, _ in rows if h == g} == {i: k for k, (i, _, _) in enumerate(sorted((t for t in rows if t[1] == g), key=lambda t: (-t[2], t[0])))}
    made = order.batches(df, ["i"], 7)
    assert {(x.i, x.batch, x.place) for x in made.collect()} == {(i, i // 7, i % 7) for i in range(2000)}
    assert order.batch_faults(made, ["i"], 7, 2000).count() == 0 and order.batches(df.limit(0), ["i"], 7).count() == 0
    broken = made.filter("i <> 3 AND batch <> 5").unionByName(made.filter("i = 20"))
    assert {x.fault: x.n for x in order.batch_faults(broken, ["i"], 7, 2000).collect()} == {"repeated keys": 1, "gaps in a batch": 2, "overfull batches": 1, "short batches": 1, "missing batches": 1, "rows too few or many": 7}


def test_farthest_points_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, "abc"[i % 3] if i % 10 else None, r.normal(size=3).round(2).tolist()) for i in range(90)] + [(200, "a", None), (None, "a", [0.0] * 3), (201, "d", [1.0, 2.0, 3.0]), (202, "d", [1.0, 2.0, 3.0]), (203, "e", [1.0])]
    got = farthest.farthest_points(spark.createDataFrame(rows, "id int, g string, v array<double>").repartition(4), 10, "id", "v", ["g"]).collect()
    for g in ("a", "b", "c", None, "d", "e"):
        own = {i: np.array(v) for i, h, v in rows if h == g and v and i is not None}
        want = [(min(own), None)]
        while len(want) < min(10, len(own)):
            near = {i: min(np.linalg.norm(v - own[j]) for j, _ in want) for i, v in own.items() if i not in [j for j, _ in want]}
            best = min(near, key=lambda i: (-near[i], i))
            want.append((best, near[best]))
        mine = sorted((x.rank, x.id, x.distance) for x in got if x.g == g)
        assert [(i, None if d is None else round(d, 9)) for _, i, d in mine] == [(i, None if d is None else round(d, 9)) for i, d in want]
    assert farthest.farthest_points(spark.createDataFrame([], "id int, v array<double>"), 3, "id", "v").count() == 0


def test_best_overlaps_equal_all_pairs(spark):
    r = random.Random(3)
    make = lambda n: [(r.choice("abc"), *sorted((r.uniform(0, 100), r.uniform(0, 100) if r.random() < 0.2 else r.uniform(0, 3)))) for _ in range(n)]
    a, b = [*make(80), ("zero", 0.0, 1.0), ("alone", 0.0, 1.0), ("point", 1.0, 1.0)], [*make(80), ("zero", 5.0, 6.0), ("point", 0.0, 2.0)]
    frames = [spark.createDataFrame(x, "g string, s double, e double") for x in (a, b)]
    for width in (None, 0.5, 1000.0):
        got = {x.g: x.best_iou for x in intervals.best_overlap(*frames, ["g"], width).collect()}
        want = {}
        for g, s1, e1 in a:
            for h, s2, e2 in b:
                if g == h:
                    want[g] = max(want.get(g, 0.0), max(0.0, min(e1, e2) - max(s1, s2)) / (max(e1, e2) - min(s1, s2)))
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], abs_tol=1e-12) for g in want)


def test_exact_tests_equal_the_sum_and_answer_for_very_many_pairs(spark):
    from fractions import Fraction

    for n in (1, 2, 7, 40, 301, 1200):
        for m in {0, n // 10, n // 3, n // 2 - 1, n // 2}:
            if 0 <= m <= n - m:
                total, term = Fraction(0), Fraction(1)
                for k in range(m + 1):
                    total += term
                    term = term * (n - k) / (k + 1)
                assert math.isclose(metrics.two_sided_half(m, n - m), min(1.0, float(2 * total / Fraction(2) ** n)), rel_tol=1e-9)
    for n, z in ((90_000, 1.3), (90_000, 3.0)):  # both sides of the switch agree
        m = int(n / 2 - z * math.sqrt(n) / 2)
        exact = metrics.two_sided_half(m, n - m)
        limit, metrics.MANY = metrics.MANY, 10
        assert abs(metrics.two_sided_half(m, n - m) - exact) < 1e-9
        metrics.MANY = limit
    rows = spark.createDataFrame([(500_000_000_000, 500_001_000_000), (0, 0), (5, 5), (None, 3), (3, 0), (0, 3)], "b long, c long")
    got = [x[0] for x in rows.select(metrics.mcnemar(F.col("b"), F.col("c"))).collect()]
    assert math.isclose(got[0], math.erfc(1_000_000 / math.sqrt(1_000_001_000_000) / math.sqrt(2)), rel_tol=1e-5) and got[3] is None
    assert [round(x, 12) for x in got[1:3] + got[4:]] == [1.0, 1.0, 0.25, 0.25]


def test_quotas_by_top_n_equal_the_rule(spark):
    r = random.Random(6)
    for n, most, totals in ((12, 40, (3, 12, 30, 57, 10_000)), (5, 3, (4, 6, 9)), (3, 200, (4, 7, 100))):
        sizes = {f"s{i}": r.randint(1, most) for i in range(n)}
        df = spark.createDataFrame([(s, i) for s, k in sizes.items() for i in range(k)] + [(None, 0)], "s string, i int")
        for total in totals:
            want = splits.quotas(sizes, total)
            assert {x.stratum: x.quota for x in splits.quota_table(df, "s", total).collect()} == want
        assert splits.stratified(df, "s", "i", 1, totals[-1]).count() == sum(splits.quotas(sizes, totals[-1]).values())
