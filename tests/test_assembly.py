"""The queries that put sets together against DuckDB, and their operators on nulls, empty sets and faults."""

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from tallyframe.operators import assembly
from tallyframe.plans import assembly as plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, DATA), duck, plans.SQL[name])


def test_difference_wants_a_true_part(spark):
    whole, part = spark.range(5), spark.range(3)
    assert sorted(r.id for r in assembly.difference(whole, part, "id").collect()) == [3, 4]
    for bad in (spark.range(6), whole):
        with pytest.raises(ValueError):
            assembly.difference(whole, bad, "id")


def test_lists_by_preference_and_position(spark):
    rows = spark.createDataFrame([(1, [], [2], [3]), (2, None, None, []), (3, [1], [2], [5, 6])], "i int, a array<int>, b array<int>, c array<int>").orderBy("i")
    got = rows.select(assembly.first_list(F.col("a"), F.col("b"), F.col("c")).alias("x"), assembly.by_position(a=F.col("b"), b=F.col("c")).alias("z")).collect()
    assert [r.x for r in got] == [[2], None, [1]]
    assert [r.z for r in got] == [[(2, 3)], None, None]


def test_missing_paths_stay_or_fail(spark):
    paths = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    known = spark.createDataFrame([("a", "x"), ("a", "x")], "old string, new string")
    assert sorted((r.p or "", r.missing) for r in assembly.rewritten(paths, "p", known).collect()) == [("", False), ("b", True), ("x", False)]
    with pytest.raises(Exception, match="no entry for b"):
        assembly.rewritten(paths, "p", known, strict=True).collect()


def test_names_by_number_and_empty_tables(spark):
    names = spark.createDataFrame([("s10",), ("s2",), ("none",), (None,)], "n string").withColumn("k", assembly.numeric_part(F.col("n")))
    assert [r.n for r in names.filter("k IS NOT NULL").orderBy("k").collect()] == ["s2", "s10"]
    empty = spark.createDataFrame([], "g int, p string, ok boolean, ratio double")
    assert assembly.answer_summary(empty, ["g"], "p", "ok", "ratio").count() == 0
    assert assembly.by_precedence([empty, empty], ["g"], "p").count() == 0
