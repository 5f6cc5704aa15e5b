"""The queries over written answers against DuckDB."""

import json

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from tallyframe.functions import embedded, rules
from tallyframe.plans import answers


@pytest.mark.parametrize("name", sorted(answers.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(answers.QUERIES[name](spark, DATA), duck, answers.SQL[name])


def read(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_objects_in_prose(spark):
    cases = {
        'a {"x": 1} b {"y": {"z": 2}} c': ['{"x": 1}', '{"y": {"z": 2}}'], '{"s": "} { \\" }"} tail': ['{"s": "} { \\" }"}'], '{"torn": {"a": 1}': [], "}{": [], "{} }": ["{}"], '[1] {"a": [1, {"b": 2}]}': ['{"a": [1, {"b": 2}]}'],
        'one "quote { only': [], '```json\n{"f": 1}\n``` {"g": 2}': ['{"f": 1}', '{"g": 2}'], "{not json} {\"k\": 0}": ['{"k": 0}'], "": [], None: [],
    }
    assert read(spark, cases, embedded.objects) == list(cases.values())
    assert read(spark, ['x {"a": 1} {"b": 2}', "none"], embedded.first_object) == ['{"a": 1}', None]
    assert embedded.spans("{" * 50_000 + "}" * 50_000) == [(0, 100_000)]


def test_judgements(spark):
    good = {"verdict": "YES", "reference_facts": ["red"], "candidate_facts": ["red"], "reason": "Same color."}
    cases = {
        json.dumps(good): ("YES", None), "<think>\n\n</think>\n\n" + json.dumps(good): ("YES", None), "<think>Some reasoning</think>" + json.dumps(good): ("UNCERTAIN", "unparseable"), "YES": ("UNCERTAIN", "unparseable"),
        '{"verdict":"YES"}': ("UNCERTAIN", "no evidence"), "truncated {": ("UNCERTAIN", "unparseable"), "[]": ("UNCERTAIN", "unparseable"), json.dumps(good | {"reference_facts": "red"}): ("UNCERTAIN", "no evidence"),
        json.dumps(good | {"verdict": "yes"}): ("UNCERTAIN", "no such verdict"), json.dumps(good | {"reason": " "}): ("UNCERTAIN", "no evidence"), json.dumps(good | {"verdict": "UNCERTAIN"}): ("UNCERTAIN", None),
        "```json\n" + json.dumps(good | {"verdict": "NO"}) + "\n```": ("NO", None), None: ("UNCERTAIN", "unparseable"),
    }
    assert [tuple(x) for x in read(spark, cases, embedded.judgement)] == list(cases.values())
    pairs = spark.createDataFrame([(["YES", "YES"],), (["NO", "NO"],), (["YES", "NO"],), (["YES", "UNCERTAIN"],), (["YES"],), (None,), (["YES", None],)], "v array<string>")
    assert [r[0] for r in pairs.select(embedded.reviews_agree(F.col("v"))).collect()] == [True, False, None, None, None, None, None]


def test_ordered_rules(spark):
    table = [rules.Rule("a", ("red car", "blue"), 0.9), rules.Rule("b", ("what .* doing", "blue car"), 0.5), rules.Rule("c", ("car",), 0.1)]
    texts = ["a red car and blue", "what is he doing", "now doing what else", "the blue car", "a car", "nothing", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("category", F.lit("old"))
    got = [tuple(r) for r in rules.categorized(df, F.col("t"), table).orderBy("i").select("category", "confidence", "matched", "fits").collect()]
    none = ("other", 0.25, [], [])
    assert got == [("a", 0.9, ["red car", "blue"], ["a", "c"]), ("b", 0.5, ["what .* doing"], ["b"]), ("b", 0.5, ["what .* doing"], ["b"]), ("a", 0.9, ["blue"], ["a", "b", "c"]), ("c", 0.1, ["car"], ["c"]), none, none, none]
    asked = {"Why did he leave after lunch?": "causal", "What happened after the fall?": "before_after", "How many dogs, and why?": "counting", "What is the man doing?": "object", "Hm": "other"}
    rows = spark.createDataFrame([(q,) for q in asked], "q string")
    assert [r.category for r in rules.categorized(rows, rules.question_text(F.col("q"), F.array(F.lit("x"))), rules.QUESTIONS).collect()] == list(asked.values())
    marks = spark.range(1).select(rules.flags({"one": (F.lit(True), "error"), "two": (F.lit(None).cast("boolean"), "warning"), "three": (F.lit(1) == 1, "info")}).alias("f")).first().f
    assert [tuple(m) for m in marks] == [("one", "error"), ("three", "info")]
