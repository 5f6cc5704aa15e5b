"""Repairs of spans, entry by entry, and the queries against DuckDB."""

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from tallyframe.operators import budgets, repairs
from tallyframe.plans import repairs as plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, DATA), duck, plans.SQL[name])


def mend(spark, spans, duration, wide=False):
    given = None if spans is None else [(*(v if v is None else float(v) for v in x[:2]), *(x[2:] or ("seen",))) for x in spans]
    df = spark.createDataFrame([(given, duration)], "x array<struct<s:double,e:double,note:string>>, d double")
    r = df.select(repairs.repaired(F.col("x"), F.col("d"), repairs.budget(F.col("d"), wide=F.lit(wide), most=200.0)).alias("r")).first().r
    return None if r.spans is None else [(x.s, x.e) for x in r.spans], [x.kind for x in r.log], r.fault, r.log


def test_repairs_one_by_one(spark):
    spans, log, fault, entries = mend(spark, [(0, 120)], 131.36)
    assert fault is None and len(spans) >= 2 and spans[0] == (0.0, 32.84) and spans[-1] == (87.16, 120.0) and log == ["split to cover"] and entries[0].n == 2
    assert mend(spark, [(0, 80)], 100.0, wide=True)[:3] == ([(0.0, 80.0)], [], None)
    spans, log, _, entries = mend(spark, [(i * 5.0, i * 5.0 + 0.2) for i in range(6)], 60.0)
    assert len(spans) == 4 and all(e - s >= 0.999 for s, e in spans) and log.count("expanded short") == 6 and log[-1] == "dropped extra" and entries[-1].n == 2
    spans, log, _, entries = mend(spark, [(-5, 3), (10, 4)], 20.0)
    assert spans == [(0.0, 3.0)] and log == ["clamped", "dropped empty"] and (entries[0].s, entries[0].to_s, entries[1].s, entries[1].e) == (-5.0, 0.0, 10.0, 4.0)
    spans, log, _, entries = mend(spark, [(0, 8), (20, 30), (40, 45)], 20.0 * 1.5)
    assert spans == [(0.0, 8.0), (20.0, 27.0)] and log == ["dropped empty", "trimmed", "enforced budget"] and (entries[1].to_s, entries[1].to_e) == (20.0, 27.0) and (entries[2].s, entries[2].e, entries[2].to_s) == (18.0, 15.0, 15.0)
    assert mend(spark, [(1.00049, 2.99951)], 10.0)[0] == [(1.001, 2.999)]
    assert mend(spark, [(120.0, 124.25759)], 124.25759)[0] == [(120.0, 124.257)]


def test_faults(spark):
    assert mend(spark, None, 10.0)[:3] == (None, [], "no list")
    assert mend(spark, [(1, None)], 10.0)[2] == "no numbers" and mend(spark, [(1, float("nan"))], 10.0)[2] == "no numbers" and mend(spark, [(1.0, 2.0)], None)[2] == "no numbers"
    assert mend(spark, [(1.0, 2.0, " ")], 10.0)[2] == "no note" and mend(spark, [(1.0, 2.0, None)], 10.0)[2] == "no note"
    assert mend(spark, [(20.0, 30.0)], 10.0)[:3] == (None, ["dropped empty"], "nothing left")
    assert mend(spark, [], 10.0)[:3] == ([], [], None)


def test_video_budgets(spark):
    rows = [(129.0, "854x480"), (60.0, "720x1280"), (1e6, "16x9"), (0.0, "1x1"), (None, "1x1"), (0.5, None), (30.0, "4000x1")]
    got = [r.b for r in spark.createDataFrame(rows, "d double, s string").select(budgets.video_budget(F.col("d"), F.col("s")).alias("b")).collect()]
    assert (got[0].frames, got[0].height, got[0].width, got[0].visual, got[0].audio, got[0].checked) == (240, 280, 560, 24000, 3289, 29849)
    assert got[1].frames == 120 and got[1].visual <= 24000 and got[1].visual / 120 <= 128 and got[1].height > got[1].width
    assert got[2].frames % 2 == 0 and got[2].checked <= 32768 and got[2].audio == 7564
    assert [x.fault for x in got] == [None, None, None, "no duration", "no duration", None, None] and got[5].frames == 2 and got[6].height >= 28


def test_video_budgets_search_a_grid_once(spark):
    rows = [(129.0, "854x480"), (60.0, "720x1280"), (1e6, "16x9"), (0.0, "1x1"), (None, "1x1"), (0.5, None), (30.0, "4000x1"), (float("nan"), "4x3")] * 3
    videos = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, d double, s string")
    got = {r.k: r.budget for r in budgets.with_video_budgets(videos, F.col("d"), F.col("s")).collect()}
    want = {r.k: r.b for r in videos.select("k", budgets.video_budget(F.col("d"), F.col("s")).alias("b")).collect()}
    assert got == want and len(got) == 24
    # The search over heights (a sequence) and the reading of sizes stand in aggregates by kind, nowhere over the rows.
    plan = plans.video_budgets(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    for what in ("sequence(1", "regexp_extract"):
        found = [line.lstrip(" :+-") for line in plan if what in line]
        assert found and all(line.startswith("Aggregate") for line in found)
