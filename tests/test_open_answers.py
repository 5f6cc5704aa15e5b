"""Rules for open answers on literal cases."""

from pyspark.sql import functions as F

from tallyframe.functions import open_answers as oa

HATS = "What is the order of the events? (a) Putting on a hat. (b) Handing a book to the other hand. (c) Throwing something at a hat. (d) Writing on the book. (e) Bumping fists."


def ask(spark, rows, column, schema):
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in made.select("i", column.alias("x")).orderBy("i").collect()]


def test_integers_in_words(spark):
    cases = {
        "twenty-three": 23, "one hundred and twenty three": 123, "two thousand and five": 2005, "zero": 0, "13": 13, "nine hundred ninety-nine thousand nine hundred ninety-nine": 999_999, "twelve thousand": 12_000,
        "two three": None, "twenty twenty": None, "one and two": None, "four or five": None, "-5": None, "2.5": None, "hundred": None, "two hundred and": None, "": None, "ten hundred": None, "two thousand thousand": None,
    }
    assert ask(spark, [(k,) for k in cases], oa.integer_of_words(F.col("t")), "t string") == list(cases.values())


def test_short_counts(spark):
    cases = {"Four times.": (4, ["time"]), "4": (4, []), "six people": (6, ["person"]), "three types of": None, "12 or 13": None, "3 apples and 5 pears": None, "about six": None, "two sound events": (2, ["sound", "event"]), "children": None, "": None}
    got = ask(spark, [(k,) for k in cases], oa.short_count(F.col("t")), "t string")
    assert [g and (g.value, g.units) for g in got] == list(cases.values())
    assert ask(spark, [(None,)], oa.short_count(F.col("t")), "t string") == [None]


def routes(spark, question, reference, answers):
    got = ask(spark, [(question, reference, a) for a in answers], oa.routed(F.col("q"), F.col("r"), F.col("a")), "q string, r string, a string")
    return [(g.correct, g.method) for g in got]


def test_counts_are_compared_with_their_units(spark):
    assert routes(spark, "How many times did applause occur?", "Four times.", ["4", "Four times.", "four times", "Five times.", "4 types"]) == [(True, "count"), (True, "exact"), (True, "exact"), (False, "count"), (None, "judge")]
    unsure = ["At 00:06 five events appeared.", "Six or seven.", "Six times.", "Six sports events.", "There were six types but five in total.", "-6"]
    assert routes(spark, "How many types of sports events were shown?", "Six.", unsure) == [(None, "judge")] * 6
    assert routes(spark, "How many types of sports events were shown?", "Six.", ["6 types."]) == [(True, "count")]


def test_sequences(spark):
    lines = "The order is: c. Throwing something at a hat. b. Handing a book to the other hand. d. Writing on the book, and a. Putting on a hat. e. Bumping fists."
    assert routes(spark, HATS, "(c)(b)(d)(a)(e)", ["c → b → d → a → e", "cbdae", "(c) then (b) then (d), (a), (e).", lines, "a, b, c, d, e"]) == [(True, "exact"), (True, "event sequence"), (True, "event sequence"), (True, "event sequence"), (False, "event sequence")]
    unsure = [
        "a, c, b", "a,c,b,d,e or a,b,c,d,e", "a,c,b,d,d",
        "The wrong sequence is: a. Throwing something at a hat. b. Handing a book to the other hand. c. Putting on a hat. d. Writing on the book. e. Bumping fists.",
        "a. Putting on a hat. c. Throwing something at a hat. b. Handing a book to the other hand. d. Writing on a book. e. Bumping fists.",
    ]
    assert routes(spark, HATS, "c, b, d, a, e", unsure) == [(None, "judge")] * 5
    swapped = "a. Putting on a hat. c. Handing a book to the other hand. b. Throwing something at a hat. d. Writing on the book. e. Bumping fists."
    assert routes(spark, HATS, "c, b, d, a, e", [swapped]) == [(None, "judge")]
    assert routes(spark, "What is the order in the video?", "(a)(b)(c)", ["(a) (c) (b)"]) == [(None, "judge")]
    assert routes(spark, "(a) One. (b) Two. (a) Three. In which order?", "a b", ["b a"]) == [(None, "judge")]


def test_answers_that_point_at_options_or_are_none(spark):
    q, r = "Are there any blue race cars?", "No, there are not."
    assert routes(spark, q, r, ["None of the above.", "All of the above", "None of above."]) == [(False, "points at options")] * 3
    assert routes(spark, q, r, ["None of the above; there are no blue race cars.", "None."]) == [(None, "judge")] * 2
    assert routes(spark, q, r, ["", None, "B", "c)", "no there are not"]) == [(False, "invalid")] * 4 + [(True, "exact")]
    assert routes(spark, None, None, ["yes"]) == [(None, "judge")]
    assert routes(spark, "When?", "2:10", ["2.10", "-5"]) == [(None, "judge")] * 2


def test_only_the_final_answer_is_read(spark):
    texts = ["<analysis>There were six people.</analysis>", "<analysis>Six.</analysis><answer>Five.", "<analysis>x</analysis><answer> y </answer>", "<answer>a b</answer><answer>c d</answer>", "<answer>B</answer>", "<answer>yes</answer><analysis>late</analysis>", "<analysis>open <answer>no</answer>", None]
    got = ask(spark, [(t,) for t in texts], oa.final_answer(F.col("t")), "t string")
    assert [tuple(g) for g in got] == [
        ("", "There were six people.", False, False), ("Five.", "Six.", True, False), ("y", "x", True, True), ("", "", False, False), ("B", "", False, False), ("yes", "late", True, False), ("no", "open", True, False), ("", "", False, False),
    ]


def test_references_that_name_undefined_events(spark):
    rows = [("(a) First event. (b) Second event. What is the order?", "(a) (b)."), ("What is the order?", "(e)(a)(c)"), ("(a) x (b) y. Order?", "c, a"), ("Who?", "A man."), ("Who?", None)]
    assert ask(spark, rows, oa.undefined_events(F.col("q"), F.col("r")), "q string, r string") == [[], ["a", "c", "e"], ["c"], None, None]
