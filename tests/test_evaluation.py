"""The evaluation queries against DuckDB, and parsers, times, spans, budgets and draws on literal cases."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from tallyframe.functions import columns, parsers, text, times
from tallyframe.operators import budgets, checks, controls, resample, scoring, splits
from tallyframe.plans import evaluation


@pytest.mark.parametrize("name", sorted(evaluation.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(evaluation.QUERIES[name](spark, DATA), duck, evaluation.SQL[name])


def read(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_answer_letters(spark):
    cases = {
        "<answer>(B)</answer>": "B", "Final  answer: [C]": "C", "answer = D": "D", "The answer is: b.": "B", "Option (a) holds": "A", "(c)": "C", "D.": "D", "<answer> c. </answer>": "C",
        "I think so": None, "": None, "answer pending": None, "AB": None, "choice e": "E",
    }
    assert read(spark, cases, parsers.answer_letter) == list(cases.values())
    assert read(spark, [None], parsers.answer_letter) == [None]


def test_one_letter_needs_agreement(spark):
    cases = {
        "<think>answer is A</think> the answer is C": ("C", None), "answer: A or option B": (None, "conflict"), "<answer>A</answer> so the answer is A": ("A", None), "\\boxed{D}": ("D", None), "reasons\nB": ("B", None),
        "nothing here": (None, "none"), "answer Z": (None, "none"),
    }
    assert [tuple(x) for x in read(spark, cases, parsers.one_letter)] == list(cases.values())


def test_other_readers(spark):
    choices = F.array(*map(F.lit, ("a red car", "blue", "a blue car")))
    assert read(spark, ["It is a red car!", "blue", "a blue car", "none"], lambda t: parsers.by_choice_text(t, choices)) == ["A", "B", None, None]
    assert read(spark, ["I say B then C", "<answer>d</answer> A", "no"], parsers.loose_letter) == ["B", "D", None]
    assert [tuple(x) for x in read(spark, ['so {"verdict": "yes"} ok', "{}", "no", '{"verdict": "maybe"}'], parsers.verdict)] == [("YES", None), ("UNCERTAIN", "no verdict"), ("UNCERTAIN", "no JSON"), ("UNCERTAIN", "unknown verdict")]
    assert [tuple(x) for x in read(spark, ["<a>x</a>", "<a>x", "y"], lambda t: parsers.tagged(t, "a"))] == [("x", 1, True), (None, 1, False), (None, 0, True)]


def test_numbers_in_words():
    right = {"zero": 0, "seventeen": 17, "forty-two": 42, "three hundred": 300, "two hundred and five": 205, "twelve thousand": 12_000, "nine hundred ninety-nine thousand nine hundred ninety-nine": 999_999, "one thousand and one": 1001}
    assert {k: text.english_integer(k) for k in right} == right
    assert all(text.english_integer(x) is None for x in ("", "hundred", "twenty twelve", "two hundred and", "thousand one", "forty zero", "one thousand zero", "five six"))


def test_texts(spark):
    assert read(spark, ["12 apples", "Seven", "twenty cars", "many", None], text.small_count) == [12, 7, 20, None, None]
    assert [tuple(x) for x in read(spark, ["640x360", "4 X 3", "wide", None], text.resolution)] == [(640, 360), (4, 3), (16, 9), (16, 9)]
    assert read(spark, ["Ｆｕｌｌ ﬁne Straße", None], text.compatible) == ["full fine strasse", None]
    assert read(spark, ["One two. Three four five six", "a b c", "One. two three four five"], lambda t: text.shortened(t, 4)) == ["One two. Three four", "a b c", "One. two three four"]
    assert read(spark, ["Up and DOWN, up"], lambda t: text.screened(t, "up|down")) == [["down", "up"]]
    ok = lambda *c: text.four_choice_problem(F.array(*map(F.lit, c)), F.lit("A"))
    got = spark.range(1).select(ok("a", "b", "c", "d"), ok("a", "b", "c"), ok("a", "A ", "c", "d"), ok("a", "", "c", "d")).first()
    assert tuple(got) == (None, "not four choices", "repeated choice", "empty choice")


def test_times(spark):
    assert read(spark, ["90", "1:30", "1:00:00.5", "x", None, "1:2:3:4"], times.seconds) == [90, 90, 3600.5, None, None, None]
    assert read(spark, ["1:60", "01:59", "90", "100:00"], times.strict_seconds) == [None, 119, None, 6000]
    assert [[tuple(s) for s in x] for x in read(spark, ["[0:10 - 0:20]; 5–3\n1-2", "none"], times.ranges)] == [[(1, 2), (10, 20)], []]
    assert [x is not None for x in read(spark, ["1-2; 3-4", "1-2 then 3-4", "4-3", "1-200", ""], lambda t: times.only_ranges(t, F.lit(100.0)))] == [True, False, False, False, False]


def spans(*pairs):
    return F.array(*(controls.span(F.lit(a), F.lit(b)) for a, b in pairs))


def test_spans_of_a_sample(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    pairs = lambda c: [tuple(s) for s in one(c)]
    assert pairs(controls.merged(spans((5, 6), (0, 2), (2, 3)))) == [(0, 3), (5, 6)]
    assert pairs(controls.clipped(spans((0, 4), (3, 8), (7, 9)), 1.5)) == [(0, 4), (4, 8)]
    assert pairs(controls.jittered(spans((0, 4), (8, 10)), "right", 0.5, F.lit(10.0))) == [(2, 6), (9, 10)]
    assert one(controls.evenly_placed(spans((0, 60), (60, 120)), F.lit(100.0))) is None
    assert one(controls.same(spans((0, 1)), spans((0, 1.0000001)))) and not one(controls.same(spans((0, 1)), spans((0, 1), (2, 3))))
    assert one(controls.problem(spans((0, 2), (1, 3)), F.lit(9.0))) == "overlap or order" and one(controls.problem(spans((2, 1)), F.lit(9.0))) == "not rising"
    assert tuple(one(controls.window(F.lit(98.0), F.lit(99.0), 4.0, 6.0, F.lit(100.0)))) == (96, 100)
    assert one(controls.hull(spans((3, 4), (1, 2))))["e"] == 4


def test_allocations(spark):
    one = lambda w, n, **k: spark.range(1).select(budgets.allocation(F.array(*map(F.lit, map(float, w))), F.lit(n), **k).alias("x")).first().x
    assert one([1, 1, 1], 10) == [4, 3, 3] and one([98, 1, 1], 10) == [8, 1, 1] and one([1, 2], 1) is None and one([3, 1], 16, unit=2) == [12, 4]
    assert sum(one(range(1, 9), 97)) == 97


def test_quotas_and_splits(spark):
    assert splits.quotas({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert splits.quotas({"a": 5, "b": 4, "c": 3}, 2) == {"a": 1, "b": 1, "c": 0}
    assert sum(splits.quotas({"a": 3, "b": 4}, 99).values()) == 7
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "k int, s string")
    assert splits.stratified(rows, "s", "k", 1, 9).groupBy("s").count().collect().__len__() == 3


def test_paired_bootstrap_is_numpys(spark):
    rng = np.random.default_rng(3)
    d = rng.choice([-1, 0, 1], 400, p=[0.2, 0.5, 0.3])
    rows = spark.createDataFrame([("x", int(v)) for v in d] + [("x", None), ("y", 1)], "g string, d int")
    got = {r.g: r for r in resample.paired_bootstrap(rows, ["g"], "d").collect()}
    draws = d[rng.integers(0, 400, (5000, 400))].mean(1)
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got["x"].n == 400 and got["x"].mean == pytest.approx(d.mean()) and got["x"].low == pytest.approx(low, abs=0.01) and got["x"].high == pytest.approx(high, abs=0.01)
    assert got["y"].low == got["y"].high == 1


def test_checks_raise(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, f string")
    with pytest.raises(ValueError):
        checks.exactly(rows, 3)
    with pytest.raises(ValueError):
        checks.one_value(rows, "f")
    assert checks.one_value(rows.filter("k = 1"), "f").count() == 1
    with pytest.raises(ValueError):
        scoring.graded(rows, rows.limit(1), "k", "f", "f")


def test_repeated_ngrams(spark):
    texts = [" ".join(["w"] * 40), " ".join(f"w{i}" for i in range(30)), "short", None]
    assert read(spark, texts, columns.repeated_ngrams) == [1 - 1 / 21, 0.0, None, None]


def test_gap_recovered_at_a_tie_does_not_hang_on_the_order_of_lines(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").filter("l_suppkey = 566").select("l_suppkey", "l_linenumber", "l_discount").toPandas()
    copies = [lines.sample(frac=1, random_state=i).assign(l_suppkey=i) for i in range(40)]
    spark.createDataFrame(pd.concat([*copies, lines.assign(l_suppkey=99, l_discount=float("nan")), lines.head(1).assign(l_suppkey=98)])).write.parquet(f"{tmp_path}/lineitem.parquet")
    means = [Fraction(sum(round(100 * x) for x in d), 100 * len(d)) for d in (lines.l_discount[lines.l_linenumber == k] for k in (1, 2, 3))]
    assert (means[1] - means[0]) / (means[2] - means[0]) == Fraction(13, 32)  # 0.40625, half way between two results
    got = {r.l_suppkey: r.recovery for r in evaluation.gap_recovered(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(40)] == [0.4063] * 40 and np.isnan(got[99]) and got[98] is None
