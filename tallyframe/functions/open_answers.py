"""Open answers against a reference, as Column expressions: rules that decide, or pass the pair on to a judge.

A rule says true or false only where it is sure; null means that a judge has
to read the pair.  Rules in turn: a missing or option-like answer is wrong, an
equal one right, one that only points at absent options wrong; where the
question defines labelled events, orders of all labels are compared; where it
asks how many, short whole numbers are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound
from .text import TENS, UNITS

# Units that a count may carry, answers that point at absent options, words that spoil a count or a sequence.
COUNT_UNITS = ["actor", "applause", "bangle", "cannon", "child", "cloud", "dancer", "event", "explanation", "formula", "gunshot", "headphone", "hostage", "instrument", "kind", "kiss", "pencil", "people", "person", "pillow", "plan", "screw", "sound", "sport", "step", "task", "time", "tool", "turtle", "type"]
POINTING = ["none of the above", "none of above", "all of the above", "all of above"]
_UNSURE = r"[,:;/?]|\b(or|not|about|approximately|at least|more|less|maybe)\b"
_MARKER = r"(?:\([A-Za-z]\)|[A-Za-z]\.(?=\s))"
_AT_MARKER = r"(?<![\p{L}\p{N}_])(?=\([A-Za-z]\)|[A-Za-z]\.\s)"
#: Sizes of a number below a hundred, by word.
_SMALL = {w: i for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}


def comparable_words(text: Column) -> Column:
    """Lower-case words and numbers with single spaces; signs and separators inside a number stay, so -5 is not 5."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([-+]?\d+(?:[.:/,]\d+)*%?|[\p{L}\p{N}_]+)"), F.lit(1)), " ")


def integer_of_words(text: Column) -> Column:
    """The number that digits or English words name, up to 999,999; null where they break the grammar of numbers."""
    t = F.lower(F.trim(text))
    known = F.create_map(*(F.lit(x) for p in _SMALL.items() for x in p))
    begin = F.struct(F.lit(0).alias("total"), F.lit(0).alias("group"), F.lit("start").alias("kind"), F.lit(0).alias("value"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        value = F.try_element_at(known, w)
        number, after_scale = value.isNotNull(), s.kind.isin("hundred", "thousand")
        tens_then_unit = (s.kind != "number") | ((s.value >= 20) & (s.value % 10 == 0) & value.between(1, 9))
        ok = (
            F.when(number, tens_then_unit).when(w == "and", after_scale)
            .when(w == "hundred", (s.group > 0) & (s.kind == "number") & (s.group < 10)).when(w == "thousand", (s.group > 0) & s.kind.isin("number", "hundred") & (s.total == 0)).otherwise(False)
        )
        total = F.when(w == "thousand", s.total + s.group * 1000).otherwise(s.total)
        group = F.when(number, s.group + value).when(w == "hundred", s.group * 100).when(w == "thousand", 0).otherwise(s.group)
        return F.struct(total.alias("total"), F.coalesce(group, F.lit(0)).alias("group"), F.when(number, "number").otherwise(w).alias("kind"), F.coalesce(value, F.lit(0)).alias("value"), (s.ok & F.coalesce(ok, F.lit(False))).alias("ok"))

    words = F.filter(F.split(F.regexp_replace(t, "-", " "), r"\s+"), lambda w: w != "")
    read = F.aggregate(words, begin, step)
    spelled = bound(read, lambda r: F.when(r.ok & ~r.kind.isin("and", "start") & (r.total + r.group <= 999_999), r.total + r.group))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(~t.rlike(r"^-"), spelled)


def singular(word: Column) -> Column:
    return F.when(word == "people", "person").when(word == "children", "child").otherwise(F.regexp_replace(word, "s$", ""))


def short_count(text: Column) -> Column:
    """(value, units) of an answer that is nothing but a count with up to three known units; null for any other."""
    t = F.lower(F.regexp_replace(text, r"\A[\s.!]+|[\s.!]+\z", ""))

    def read(words: Column) -> Column:
        splits = F.transform(
            F.sequence(F.size(words), F.greatest(F.size(words) - 3, F.lit(1)), F.lit(-1)),
            lambda n: F.struct(integer_of_words(F.array_join(F.slice(words, 1, n), " ")).alias("value"), F.transform(F.slice(words, n + 1, 3), singular).alias("units")),
        )
        return F.get(F.filter(splits, lambda s: s.value.isNotNull() & F.forall(s.units, lambda u: u.isin(COUNT_UNITS))), F.lit(0))

    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.when((t != "") & ~t.rlike(_UNSURE), bound(words, lambda w: F.when(F.size(w) > 0, read(w))))


def marked_events(text: Column) -> Column:
    """(letter, body) of every event marked (a) or a., in order."""
    pieces = F.filter(F.split(text, _AT_MARKER), lambda p: p.rlike(rf"\A{_MARKER}"))
    return F.transform(pieces, lambda p: F.struct(F.lower(F.regexp_extract(p, r"([A-Za-z])", 1)).alias("letter"), F.regexp_replace(p, rf"\A{_MARKER}", "").alias("body")))


def event_definitions(question: Column) -> Column:
    """(letter, body) of the labelled events of a question about an order; null unless three or more different labels each have a text."""

    def check(events: Column) -> Column:
        named = F.transform(events, lambda e: F.struct(e.letter.alias("letter"), comparable_words(F.regexp_replace(e.body, r"\A[\s,.;:]+|[\s,.;:]+\z", "")).alias("body")))
        letters = F.transform(events, lambda e: e.letter)
        fits = (F.size(events) >= 3) & (F.size(F.array_distinct(letters)) == F.size(events)) & F.forall(events, lambda e: e.body.rlike(r"[^\s,.;:]"))
        return F.when(fits, named)

    return F.when(question.rlike(r"(?i)\b(order|sequence|chronological)\b"), bound(marked_events(question), check))


def pure_sequence(text: Column, letters: Column) -> Column:
    """The labels of a text that is nothing but each of ``letters`` once, in some order; else null."""

    def check(found: Column) -> Column:
        fits = (F.size(found) == F.size(letters)) & (F.size(F.array_intersect(found, letters)) == F.size(letters))
        return F.when(fits, found)

    compact = F.regexp_replace(F.regexp_replace(F.lower(text), r"\bthen\b", ""), r"[\s(),.;:\[\]{}→>\-]+", "")
    return bound(F.filter(F.split(compact, ""), lambda c: c != ""), check)


def described_sequence(text: Column, definitions: Column) -> Column:
    """The labels of a text that lists each defined event once, by label or by label and its very words; else null."""

    def check(events: Column) -> Column:
        letters = F.transform(events, lambda e: e.letter)
        known = F.map_from_entries(definitions)
        prefix = F.trim(F.element_at(F.split(text, _AT_MARKER), 1))
        prefix = F.when(~prefix.rlike(rf"\A{_MARKER}"), prefix).otherwise("")
        clean = (prefix == "") | (prefix.rlike(r"(?i)\b(order|sequence)\b") & ~prefix.rlike(r"(?i)\b(not|wrong|incorrect|alternative|instead|example)\b") & prefix.endswith(":"))

        def same(e: Column) -> Column:
            body = F.regexp_replace(F.regexp_replace(e.body, r"\A[\s,.;:→>-]+|[\s,.;:→>-]+\z", ""), r"(?i)(?:[,;]?\s+and)\z", "")
            said = comparable_words(body)
            return (F.regexp_replace(body, r"[\s,;]", "") == "") | F.coalesce(said == F.try_element_at(known, e.letter), F.lit(False))

        whole = (F.size(events) == F.size(definitions)) & (F.size(F.array_distinct(letters)) == F.size(events)) & F.forall(letters, lambda x: F.array_contains(F.map_keys(known), x))
        return F.when(whole & clean & F.forall(events, same), letters)

    return bound(marked_events(text), check)


def counts_agree(question: Column, reference: Column, candidate: Column) -> Column:
    """Whether two short counts agree; null unless the candidate's units are the reference's or are named in the question."""
    words = F.transform(F.regexp_extract_all(F.lower(question), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), singular)
    kind = singular(F.regexp_extract(F.lower(question), r"^\s*how many\s+(times|types|kinds)\b", 1))
    asked = (kind == "") | F.coalesce(F.get(candidate.units, F.lit(0)) == kind, F.lit(False))
    fits = (F.size(candidate.units) == 0) | (candidate.units == reference.units) | ((F.size(reference.units) == 0) & asked & F.forall(candidate.units, lambda u: F.array_contains(words, u)))
    return F.when(fits, reference.value == candidate.value)


def routed(question: Column, reference: Column, answer: Column, valid: Column | None = None) -> Column:
    """(correct, method): methods are invalid, exact, points at options, event sequence, count, and judge (correct is null).

    A null question or reference leaves all but invalid answers to the judge.
    """
    ok = (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))) & F.coalesce((answer != "") & ~answer.rlike(r"(?i)\A[A-D][.)]?\z"), F.lit(False))
    said, right = comparable_words(answer), comparable_words(reference)

    def rules(x: Column) -> Column:
        letters = F.transform(x.events, lambda e: e.letter)
        order = bound(F.struct(pure_sequence(reference, letters).alias("a"), F.coalesce(pure_sequence(answer, letters), described_sequence(answer, x.events)).alias("b")), lambda s: s.a == s.b)
        many = F.coalesce(question.rlike(r"(?i)^\s*how many\b"), F.lit(False))
        count = F.when(many, bound(F.struct(short_count(reference).alias("a"), short_count(answer).alias("b")), lambda s: F.when(s.a.isNotNull() & s.b.isNotNull(), counts_agree(question, s.a, s.b))))
        both = F.struct(F.when(x.events.isNotNull(), order).alias("order"), count.alias("count"))
        return bound(both, lambda r: F.when(r.order.isNotNull(), _verdict(r.order, "event sequence")).when(r["count"].isNotNull(), _verdict(r["count"], "count")).otherwise(_verdict(None, "judge")))

    pointing = F.coalesce(said.isin(POINTING) & ~right.isin(POINTING), F.lit(False))
    decided = F.when(~ok, _verdict(False, "invalid")).when(F.coalesce(said == right, F.lit(False)), _verdict(True, "exact")).when(pointing, _verdict(False, "points at options"))
    return decided.otherwise(bound(F.struct(event_definitions(question).alias("events")), rules))


def _verdict(correct, method: str) -> Column:
    correct = correct if isinstance(correct, Column) else F.lit(correct)
    return F.struct(correct.cast("boolean").alias("correct"), F.lit(method).alias("method"))


def final_answer(response: Column) -> Column:
    """(answer, analysis, valid, ordered) of a response: the one answer tag's content (its closing may be missing), never text from analysis.

    Several answer tags hold no answer.  valid: there is one, and it is no
    option letter; ordered: one closed analysis stands before one closed answer.
    """
    t = F.coalesce(response, F.lit(""))

    def read(x: Column) -> Column:
        closed = F.regexp_extract_all(x, F.lit(r"(?is)<answer>\s*(.*?)\s*</answer>"), F.lit(1))
        opened = F.regexp_count(x, F.lit(r"(?i)<answer>"))
        tail = F.trim(F.regexp_extract(x, r"(?is)<answer>(.*)\z", 1))
        tail = F.regexp_replace(tail, r"\A\s+|\s+\z", "")
        open_ended = F.when((F.size(closed) == 0) & (opened == 1) & ~tail.rlike(r"(?i)<\s*/?\s*(?:analysis|answer)\b"), tail)
        answer = F.when((F.size(closed) == 1) & (opened == 1), F.get(closed, F.lit(0))).otherwise(F.coalesce(open_ended, F.lit("")))
        thoughts = F.regexp_extract_all(x, F.lit(r"(?is)<analysis>\s*(.*?)\s*</analysis>"), F.lit(1))
        begun = F.regexp_extract(x, r"(?is)<analysis>(.*?)(?:<answer>|\z)", 1)
        analysis = F.when(F.size(thoughts) == 1, F.get(thoughts, F.lit(0))).when((F.size(thoughts) == 0) & (F.regexp_count(x, F.lit(r"(?i)<analysis>")) == 1), F.regexp_replace(begun, r"\A\s+|\s+\z", "")).otherwise("")
        in_order = (F.size(thoughts) == 1) & (F.size(closed) == 1) & x.rlike(r"(?is)</analysis>.*<answer>")
        return bound(F.struct(answer.alias("answer"), analysis.alias("analysis"), in_order.alias("in_order")), lambda r: _checked(r))

    def _checked(r: Column) -> Column:
        valid = (r.answer != "") & ~r.answer.rlike(r"(?i)\A[A-D][.)]?\z")
        return F.struct(r.answer.alias("answer"), r.analysis.alias("analysis"), valid.alias("valid"), ((r.analysis != "") & valid & r.in_order).alias("ordered"))

    return bound(t, read)


def undefined_events(question: Column, reference: Column) -> Column:
    """Labels of a reference that is a sequence of labels but that the question does not define; null for other references."""
    compact = F.regexp_replace(F.lower(reference), r"[\s(),.;:\[\]{}→>\-]+", "")
    letters = F.filter(F.split(compact, ""), lambda c: c != "")
    sequence = compact.rlike(r"\A[a-z]{2,}\z") & (F.size(F.array_distinct(letters)) == F.size(letters)) & reference.rlike(r"\A\s*(?:\(?[A-Za-z]\)?[\s,.;:→>\-]*)+\z")
    return F.when(sequence, F.array_sort(F.array_except(letters, F.transform(marked_events(question), lambda e: e.letter))))
