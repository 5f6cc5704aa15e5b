"""Routing, options by letter, consistency and manifests on literal cases; the queries against DuckDB."""

import gzip
import json
import math

import pytest
from conftest import DATA, same
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.functions import options, routing
from tallyframe.operators import consistency
from tallyframe.plans import runs
from tallyframe.sources import manifests


@pytest.mark.parametrize("name", sorted(runs.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(runs.QUERIES[name](spark, DATA), duck, runs.SQL[name])


def ask(spark, rows, schema, column):
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in made.select("i", column.alias("x")).orderBy("i").collect()]


def test_options(spark):
    rows = [([-0.2, -2.5, -0.1, 1000.0],), ([1000.0, 1001.0, None, float("nan")],), ([],), (None,)]
    got = ask(spark, rows, "s array<double>", options.grouped_probabilities(F.col("s"), {"A": [0], "B": [1, 2], "C": [9]}))
    assert got[0].keys() == {"A", "B"} and math.isclose(sum(got[0].values()), 1) and math.isclose(got[0]["A"], math.exp(-0.2) / (math.exp(-0.2) + math.exp(-2.5) + math.exp(-0.1)))
    assert math.isclose(got[1]["B"], 1 / (1 + math.exp(-1))) and got[2] == {} and got[3] in ({}, None)
    assert ask(spark, [({"b": 1.0, "a": 1.0, "c": 0.5},), ({},)], "m map<string,double>", options.best_key(F.col("m"))) == ["a", None]
    assert ask(spark, [(0.0, 1.0)], "a double, b double", options.log_gap(F.col("a"), F.col("b"))) == [math.log(1e-12)]
    rows = [("Option B beats choice a; answer D and options", ["one.", "$2 \\x"]), ("none", ["x"]), (None, ["x"])]
    got = ask(spark, rows, "t string, o array<string>", options.without_letters(F.col("t"), F.col("o")))
    assert tuple(got[0]) == ('the answer "$2 \\x" beats the answer "one"; answer D and options', 2) and tuple(got[1]) == ("none", 0) and got[2].text is None


def test_routing(spark):
    assert ask(spark, [(t, False) for t, _ in runs.UNREAD] + [("B", True), (None, None)], "t string, c boolean", routing.unread_kind(F.col("t"), F.col("c"))) == [k for _, k in runs.UNREAD] + ["conflicting choices", "no field"]
    review = "r array<struct<verdict:string,reason:string>>, m boolean"
    rows = [([("YES", "ok"), ("NO", "Reference is not provided")], True), ([("YES", None)], None), ([], False), (None, None), ([("UNCERTAIN", "unparseable")], False), ([("NO", "vague")], False)]
    assert ask(spark, rows, review, routing.unresolved_reasons(F.col("r"), F.col("m"))) == [
        ["reference by hand", "reviewers disagree", "reference may not suffice"], ["semantic review"], ["no judge yet"], ["no judge yet"], ["judge's form"], ["answer is ambiguous"],
    ]
    rows = [(["x", "y"], "B", "B", "y", True), (["x", "y"], "A", "B", "x", True), (["x", "y"], "A", "A", "y", True), (["x"], "C", "A", "x", True), (["x"], "AB", "A", "x", True), (["x"], None, "A", "x", True), (["x"], "A", "A", "x", False)]
    got = ask(spark, rows, "c array<string>, a string, g string, o string, v boolean", routing.old_answer(*map(F.col, "cagov")))
    assert got == ["same text, same letter", "same text, another letter", "another text", "no valid answer", "no valid answer", "no valid answer", "question was invalid"]
    assert ask(spark, [("fixed", "bad"), (None, "bad"), (None, "other"), (None, None)], "r string, o string", routing.final_state(F.col("r"), F.col("o"), {"bad": "failed"})) == ["fixed", "failed", "other", None]
    rows = [(True, None, None, None), (None, False, True, False), (None, False, False, False), (True, True, True, True), (False, True, False, None)]
    got = ask(spark, rows, "a boolean, r boolean, e boolean, n boolean", routing.regraded(F.col("a"), F.col("r"), F.col("e"), F.col("n")))
    assert got == [True, False, None, None, False]  # in the last row the review has no evidence


def test_contradicting_grades_raise(spark):
    df = spark.createDataFrame([(True, False, True, False)], "a boolean, r boolean, e boolean, n boolean")
    with pytest.raises(PySparkException, match="contradicts"):
        df.select(routing.regraded(F.col("a"), F.col("r"), F.col("e"), F.col("n"))).collect()


def test_views_against_an_anchor(spark):
    rows = [("s1", "G", "A", "A"), ("s1", "V", "B", "A"), ("s2", "G", "B", "A"), ("s2", "V", "A", "A"), ("s3", "G", None, "C"), ("s3", "V", None, "C"), ("s4", "V", "A", "A"), ("s5", "G", "A", None), ("s5", "V", "B", None)]
    got = {r.view: r for r in consistency.against_anchor(spark.createDataFrame(rows, "k string, view string, p string, gold string"), "k", "view", "p", "gold", "G").collect()}
    assert tuple(got["G"])[1:] == (4, 2, 1, 0.5, 0, 0, 0, 0.0) and tuple(got["V"])[1:] == (4, 2, 1, 0.5, 3, 1, 1, 0.0)


def test_manifests(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b\n\na\n")
    assert sorted(r.id for r in manifests.id_lines(spark, str(tmp_path / "ids.txt"), 2).collect()) == ["a", "b"]
    with pytest.raises(manifests.Mismatch, match="3 expected"):
        manifests.id_lines(spark, str(tmp_path / "ids.txt"), 3)
    (tmp_path / "twice.txt").write_text("a\na\n")
    with pytest.raises(manifests.Mismatch, match="unique"):
        manifests.id_lines(spark, str(tmp_path / "twice.txt"))
    for name, body in (("good", {"count": 2, "ids": ["x", "y"]}), ("short", {"count": 3, "ids": ["x", "y"]}), ("bare", {"ids": ["x"]})):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump(body, f)
    assert sorted(r.id for r in manifests.id_manifest(spark, str(tmp_path / "good.json.gz")).collect()) == ["x", "y"]
    for name in ("short", "bare"):
        with pytest.raises(manifests.Mismatch):
            manifests.id_manifest(spark, str(tmp_path / f"{name}.json.gz"))
    (tmp_path / "qa.json").write_text(json.dumps({"v1": {"task0": {"question": "q0", "kind": "a"}, "task1": {"question": "q1", "kind": "b"}}, "v2": {"task0": {"question": "q2", "kind": "a"}, "task3": None}}, indent=1))
    tasks = manifests.nested_tasks(spark, str(tmp_path / "qa.json"), "question:string,kind:string", F.col("kind") == "a")
    assert sorted(tuple(r) for r in tasks.collect()) == [("v1::task0", "v1", "task0", "q0", "a"), ("v2::task0", "v2", "task0", "q2", "a")]
    assert [r.id for r in manifests.nested_tasks(spark, str(tmp_path / "qa.json"), "question:string,kind:string", limit=1).collect()] == ["v1::task0"]


def test_merged_files_shards_and_latest_records(spark, tmp_path):
    put = lambda name, *rows: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows)))
    put("run/shard_0/results.jsonl", ("a", 1), ("b", 2), ("a", 3))
    put("run/shard_1/results.jsonl", ("a", 4), ("c", 5))
    assert sorted(tuple(r) for r in manifests.merged_or_shards(spark, str(tmp_path / "run"), "k string, v long", "k").collect()) == [("a", 1), ("b", 2), ("c", 5)]
    assert sorted(tuple(r) for r in manifests.latest(spark, str(tmp_path / "run/*/results.jsonl"), "k string, v long", "k").collect()) == [("a", 4), ("b", 2), ("c", 5)]
    put("run/results.jsonl", ("z", 9), ("z", 8))
    assert [tuple(r) for r in manifests.merged_or_shards(spark, str(tmp_path / "run"), "k string, v long", "k").collect()] == [("z", 9)]
