"""Every query of the library against its SQL, and literal cases."""

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from tallyframe.functions import columns as fx
from tallyframe.functions import parsers
from tallyframe.operators import intervals, joins, metrics, pairing, resample
from tallyframe.plans import screening
from tallyframe.sources import records
from tallyframe.streaming import progress


@pytest.mark.parametrize("name", sorted(screening.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(screening.QUERIES[name](spark, DATA), duck, screening.SQL[name])


def test_tiers(spark):
    rows = spark.createDataFrame([(1, 0.0), (0, 0.1), (0, 0.0999), (-1, 0.9), (None, 0.5)], "dc int, dp double")
    assert [r[0] for r in rows.select(pairing.tier(F.col("dc"), F.col("dp"))).collect()] == ["A", "B", "D", "C", "D"]


def test_tri_state_counts_undecided_rows_apart(spark):
    rows = spark.createDataFrame([(True,), (None,), (False,), (None,)], "c boolean")
    r = rows.agg(*metrics.aliased(metrics.tri_state(F.col("c")))).first()
    assert (r.n_true, r.n_false, r.n_undecided, r.accuracy, r.lower, r.upper) == (1, 1, 2, None, 0.25, 0.75)


def test_mcnemar_of_a_few_and_of_no_pairs(spark):
    rows = spark.createDataFrame([(1, 5), (0, 0), (288, 224)], "b long, c long")
    got = [r[0] for r in rows.select(metrics.mcnemar(F.col("b"), F.col("c"))).collect()]
    assert got == pytest.approx([2 * 7 / 64, 1.0, 0.0053], abs=1e-4)


def test_union_merges_touching_spans_and_halo_is_clamped(spark):
    spans = spark.createDataFrame([("a", 3.0, 5.0), ("a", 1.0, 4.0), ("a", 7.0, 8.0)], "k string, s double, e double")
    assert sorted((r.s, r.e) for r in intervals.union(spans, ["k"]).collect()) == [(1.0, 5.0), (7.0, 8.0)]
    assert [(r.s, r.e) for r in intervals.union(spans, ["k"], halo=2.0, low=F.lit(0.0), high=F.lit(9.0)).collect()] == [(0.0, 9.0)]
    assert [(r.s, r.e) for r in intervals.gaps(intervals.union(spans, ["k"]), ["k"]).collect()] == [(5.0, 7.0)]


def test_strict_join_refuses_repeats_and_gaps(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.strict_join(a, b, "k").count() == 2
    with pytest.raises(ValueError, match="repeated"):
        joins.strict_join(a, b.union(b), "k")
    with pytest.raises(ValueError, match="missing"):
        joins.strict_join(a, b.limit(1), "k")


def test_softmax_entropy_and_margin(spark):
    r = spark.createDataFrame([([0.0, 0.0],), ([100.0, -900.0],)], "x array<double>").select(fx.softmax(F.col("x")).alias("p")).select(fx.entropy(F.col("p")), fx.margin(F.col("p"))).collect()
    assert [tuple(x) for x in r] == [pytest.approx((1.0, 0.0)), pytest.approx((0.0, 1.0))]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_bootstrap_covers_the_mean_and_ignores_partitioning(spark):
    rows = spark.range(4000).select((F.col("id") % 200).alias("c"), F.when(F.col("id") % 10 < 9, (F.col("id") % 4 == 0).cast("int")).alias("x"), F.lit("g").alias("g"))
    a, b = (resample.cluster_bootstrap(r, ["g"], "c", "x", 400).first() for r in (rows, rows.repartition(7)))
    assert a.n == 3600 and a.low < a["mean"] < a.high and a.high - a.low < 0.2
    assert (b.low, b.high) == pytest.approx((a.low, a.high))


def test_parsers(spark):
    texts = ["<answer>D</answer>", "Option C.", "b", "The answer is B", "Because the scene changes", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parsers.answer_letter(F.col("t"))).collect()] == ["D", "C", "B", "B", None, None, None]
    times = spark.createDataFrame([("01:02:03.5",), ("00:54",), ("x",), (None,)], "t string")
    assert [r[0] for r in times.select(parsers.clock_seconds(F.col("t"))).collect()] == [3723.5, 54.0, None, None]


def test_json_lines_and_rejection(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"id": 1, "p": 0.5}\n{"id": 2}\n{"id": 3, "p"')
    good, bad = records.read_json_lines(spark, str(tmp_path / "a.jsonl"), T._parse_datatype_string("id long, p double"))
    assert [r.id for r in good.collect()] == [1, 2] and len(bad.collect()) == 1
    kept, out = records.accepted(good, {"no p": F.col("p").isNull(), "small": F.col("p") < 0.1})
    assert [r.id for r in kept.collect()] == [1] and [(r.id, r.reason) for r in out.collect()] == [(2, "no p")]
    records.write_json_lines(kept, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_streams_of_progress(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("u1", "full", "running", "null", "00:01"), ("u1", "full", "complete", "true", "00:09"), ("u2", "gold", "failed", "null", "00:12"), ("u2", "gold", "failed", "null", "00:13")]
    (source / "1.json").write_text("".join(f'{{"unit":"{u}","view":"{v}","status":"{s}","correct":{c},"at":"2024-01-01T{t}:00Z"}}\n' for u, v, s, c, t in rows) + '{"unit":')
    for name, build, mode in (("snap", progress.snapshot, "complete"), ("chg", progress.changes, "append")):
        q = build(progress.read_units(spark, str(source))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {(r.view, r.n, r.complete, r.failed) for r in spark.table("snap").collect()} == {("full", 2, 1, 0), ("gold", 2, 0, 2)}
    assert {(r.unit, r.before, r.status) for r in spark.table("chg").collect()} == {("u1", None, "running"), ("u1", "running", "complete"), ("u2", None, "failed")}
