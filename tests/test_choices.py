"""Readers of final choices on literal answers, reader by reader."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import choices

MOODS = ["Happy", "Angry", "Sad", "Indifferent"]

EXPLICIT = {
    "D. Thrilled.": "D", "C. Two astronauts.": "C", "C. No, they do not.": "C", "B. Step three.": "B", "D (a), (d), (": "D", "D. Two.": "D", "D. From straight to curved.": "D",
    "C. December 4th.": "C", "C 🎉": "C", "A. Three times. But also...": "A", "B": "B", "b": "B", "(C) yes": "C", "[D]": "D", "Ｂ．": "B",
    "A dog is standing near the door.": "none", "A Nineteen": "none", "The answer can be inferred from the video.": "none", "Answer: A dog.": "none", "The final answer is Because the man left.": "none",
    "A. Four.\nFinal answer: B.": "conflict", "<answer>A</answer><answer>B</answer>": "conflict", "A. Four.\nB. Six.": "conflict", "A or B": "conflict", "C. Two, or D. Three": "conflict",
    "<analysis>(a), (b), (c), (d)</analysis><answer>D</answer>": "D", "<analysis>A. seems plausible. B. also occurs.</analysis>Final answer: C.": "C",
    "Analysis: A. could describe the opening event.\nFinal answer: B": "B", "<analysis>A. is discussed, B. another event. Final answer: C.": "C",
    "<analysis>The events are (a), (c), (b).": "none", "D. (A), (B), (C)": "D", "The final answer is B": "B", "": "none",
}

FIELD = {
    "<option>B</option>": "B", "<answer>Option: B</answer>": "B", "<answer>Choice is B": "B", "A. Wrong.\nC. Wrong.<answer>B</answer>": "B", "<analysis>The answer is C</analysis>": "none",
    "<analysis>the answer is C": "none", "<answer>A</answer><answer>B</answer>": "conflict", "D. yes": "D",
}

TAGGED = {
    "<analysis>Evidence.</analysis>\n<B>": "B", "<analysis>Evidence.</analysis>\n<D>\n</D>": "D", "<analysis>Evidence.</analysis>\n<D>...</D>": "D",
    "<analysis>Evidence.</analysis>\n<A>\nExplanation.\n</answer>": "A", "Some evidence.\n<analysis>D</analysis>": "D", "Some evidence.\n<analysis>\nC.\n</analysis>.": "C",
    "<analysis>Evidence.</analysis><solution>B</solution>": "B", "A. is unlikely.\nC. also unlikely.\n\nB": "B", "<analysis>Evidence.</analysis>\nOption B.": "B",
    "<analysis>Evidence, still open.\nAnswer: C": "C", "<analysis>Evidence, still open.\n<B>": "B",
    "<analysis>Option B is plausible.</analysis>": "none", "<analysis>The answer is C": "none", "<analysis>The answer is C.</analysis>": "none", "<analysis><B> is merely an example.</analysis>": "none",
    "<analysis>B</analysis>\nMore reasoning without a final answer.": "none", "<C5></C5>": "none", "<C13B944D-1C21-4483-A774-3207A45AC644>": "none", "<answer></answer>": "none",
    "<answer>A dog</answer>": "none", "A or B": "conflict", "The answer is the red cup.": "none",
    "<B>C</B>": "conflict", "<c>D</c>": "conflict", "<B></C>": "conflict", "Therefore, the answer is D.\n\n<analysis>B</analysis>": "conflict", "<solution>A</solution><answer>B</answer>": "conflict",
    "<B>\n<C>": "conflict", "<answer>A</answer><answer>B</answer>\nD": "conflict",
    "<answer>B</answer>": "B", "<answer>B.</answer>": "B", "<answer>Option: B</answer>": "B", "<option>B</option>": "B", "<analysis>A or C.</analysis><answer>B</answer>": "B",
    "A. Wrong.\nC. Wrong.<answer>B</answer>": "B", "<C>\n<answer>B</answer>": "B", "<answer>B</answer>\n<analysis>A</analysis>": "B", "<answer>Choice is B": "B",
}

SPOKEN = {
    **{f"<answer>{body}</answer>": "D" for body in (
        "The correct answer is D because it matches.", "Given the reference, the correct answer is 'D'.", "Therefore, the correct answer is D, as it matches.",
        "D is the correct response because the scene confirms it.", "The sequence presented as the answer 'D' is correct.", "Answer should be: D.", "I will choose D.", "<p> D. </p>", "The correct answer is 'D.'",
    )},
    "<analysis>Evidence.\n<answer>C.</answer>\n</analysis>": "C", "<analysis>Evidence.\nAnswer: C.</analysis>": "C", "<analysis>Evidence.\nAnswer is C.\n</analysis>": "C",
    "<answer>A dog.</answer>": "none", "<answer>Angry.</answer>": "none", "<analysis>The correct answer is D because it matches.</analysis>": "none", "<answer>The answer is D or C.</answer>": "conflict",
    "<answer>The answer is A dog.</answer>": "none", "<answer>B is wrong and C is not clear.</answer>": "none", "<answer>AC</answer>": "none", "<answer>E.</answer>": "none",
    "<answer>The answer is A. The correct answer is B.</answer>": "conflict", "<answer>B</answer><answer>The answer is A because...</answer>": "conflict", "<answer>A. Text.\nB. Other text.</answer>": "conflict",
}

#: Answer, decision, options (MOODS if none).
FINAL = [
    *((t, "B", None) for t in (
        "<analysis>Evidence.</analysis> B </answer>", "<analysis>Evidence.</analysis></answer>B.</answer>", "<analysis>Evidence.</analysis>\\</answer\\>B\\</answer\\>", "<analysis>Evidence.</analysis> B </answer>B",
        "<analysis>Evidence.</analysis><TOPUP>B</TOPUP>", "<answer>B,</answer>", "<answer>B - Angry.</answer>", "<answer>Angry.</answer>", "<answer>**ANGRY**</answer>", "<solution>The final answer is Angry.</solution>",
        "<analysis>He mentions C.</analysis>Angry.", "<answertopic>Angry.</answertopic>",
    )),
    ("<answer>A van.</answer>", "C", ["Bus", "Taxi", "Van", "APC"]), ("<answer>25,000.</answer>", "B", ["25001", "25000", "5000", "None of the above"]),
    ("<answer>The third position.</answer>", "C", ["the 1st", "the 2nd", "the 3rd", "the 4th"]), ("<answer>Three.</answer>", "B", ["2", "3", "4", "5"]),
    *((t, "none", None) for t in (
        "<analysis>The answer is B.</analysis>", "<analysis>Angry.</analysis><answer></answer>", "<answer>Not angry.</answer>", "<answer>The person might be angry or sad.</answer>", "<answer>Grateful.</answer>",
        "<answer>E</answer>", "<analysis>Evidence.\nB", "<answer>A dog.</answer>", None,
    )),
    *((t, "conflict", None) for t in (
        "<answer>B</answer><answer>C</answer>", "<answer>Angry</answer><answer>Sad</answer>", "<answer>A</answer><answer>Angry</answer>", "<analysis>Evidence.</analysis><D>C</D>", "<analysis>Evidence.</analysis><D>\nC\n</D>",
        "<analysis>Evidence.</analysis><D>\nC", "<analysis>Evidence.</analysis>, B, C, or D.", "<answer>B, C, A, D</answer>", "<answer>A, B, C, or D (Given the reference...)</answer>", "<analysis>Evidence.</analysis>B</answer>C",
        "<analysis>Evidence.</analysis>A<analysis>More evidence.</analysis>B",
    )),
    ("<answer>Angry.</answer>", "conflict", ["Angry", "Happy", "ANGRY.", "Sad"]),
    ("<analysis>A. One thought. <analysis>B. Another.</analysis>C. More.</analysis>\nB", "B", None), ("<answer>Angry</answer>", "D", ["Sad", "Happy", "Indifferent", "Angry"]),
    ("<answer>B</answer>", "B", ["E", "F", "G", "B"]), ("A and B could fit. <analysis>Evidence.</analysis>\nC</answer>", "C", None),
    ("<analysis>Evidence.</analysis><answer>B</answer>\nA. Compared option\nC. Another comparison", "B", None), ("<analysis>Evidence.</analysis>\nA. Compared option\nC. Another comparison\nB", "B", None),
    ("<answer>C</answer>", "invalid", ["yes", "no"]), ("<answer>A</answer>", "none", ["only"]),
]


def decided(spark, cases, column):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, o array<string>")
    return [r.d.letter or r.d.reason for r in rows.select("i", column.alias("d")).orderBy("i").collect()]


@pytest.mark.parametrize("reader, cases", [("explicit_choice", EXPLICIT), ("field_choice", FIELD), ("tagged_choice", TAGGED), ("spoken_choice", SPOKEN)])
def test_literal_answers(spark, reader, cases):
    got = decided(spark, [(t, None) for t in cases], getattr(choices, reader)(F.col("t")))
    assert dict(zip(cases, got)) == cases


def test_final_choices(spark):
    got = decided(spark, [(t, o or MOODS) for t, _, o in FINAL], choices.final_choice(F.col("t"), F.col("o")))
    assert [(t, g) for (t, _, _), g in zip(FINAL, got)] == [(t, w) for t, w, _ in FINAL]


def test_provenance_and_keys(spark):
    row = spark.range(1).select(choices.explicit_choice(F.lit("A. Four.\nFinal answer: B.")).alias("d"), choices.strictly_formatted(F.lit(" b ")).alias("s"), choices.strictly_formatted(F.lit("b.")).alias("l")).first()
    assert {(c.letter, c.scope, c.rule) for c in row.d.candidates} == {("A", "outside", "at the start"), ("A", "outside", "in a list"), ("B", "outside", "announced")}
    assert row.s and not row.l
    keys = spark.createDataFrame([(x,) for x in ("The  Van!", "“Five”", "1,234", "the 2nd place", "Second", "<b>x</b> - y", "third rail", "12th")], "t string").select(choices.option_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in keys] == ["van", "5", "1234", "place 2", "place 2", "x - y", "third rail", "place 12"]
    parts = spark.createDataFrame([("a<analysis>b<analysis>c</analysis>d</analysis> e </analysis>f",), ("x",), ("",)], "t string").select(choices.outside_parts(F.col("t")).alias("p")).collect()
    assert [r.p for r in parts] == [["a", "e", "f"], ["x"], []]
