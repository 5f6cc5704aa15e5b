"""Final choices in model answers, as Column expressions: candidates with their provenance, folded to one decision.

A reader lists candidates (letter, scope, rule): which part of the text a
letter comes from and which rule found it.  The decision is the letter that all
candidates name, else none, with the reason.  Texts are read in parts: a
*field* is what an answer tag holds, *analysis* never decides (its tags may
nest), *outside* is the rest.  Nothing but expressions of the JVM is used; an
intermediate text is bound to a lambda's variable, so it is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound

_CANDIDATE = "array<struct<letter:string,scope:string,rule:string>>"

# The forms in which an answer names its choice.
#: A marked letter at a place: alone up to the end, followed by a mark, in brackets, or before a parenthesis or a symbol.
_MARK = r"(?:(?=[A-Da-d]\s*{end})|(?=[A-D][.):](?:\s|\z|\W))|(?=(?:\([A-D]\)|\[[A-D]\])(?:\s|\z|\W))|(?=[A-D]\s+(?:\(|\p{{So}})))[(\[]?([A-Da-d])"
_WHOLE, _LINE = _MARK.format(end=r"\z"), _MARK.format(end=r"(?:\n|\z)")
#: Words that announce a final answer.
_ANNOUNCE = r"(?i:\b(?:final\s+answer|answer)\b\s*(?:is\s+|[:=]\s*|(?=[A-Da-d](?!\w))))"
_OPEN_ANSWER, _FIELDS = r"(?i:<answer\s*>)", "answer|option|solution|answertopic"
#: A letter in a sentence, with quotes or emphasis around it, and what may follow it.
_SAID = r"[\s'\"`*]*\(?([A-D])(?:(?<=\(.)\)|(?<!\(.))[\s'\"`*]*"
_ENDS = r"(?=\z|[.,:;!?)'\"`*]|(?<=\s)(?:because|as|since|which|for\s+the|due\s+to|given|based\s+on)\b)"
_SENTENCES = {
    "the answer is": r"(?i)\b(?:(?:the\s+)?(?:correct|final|best)\s+)?answer\s*(?:is\s*:?[ \t]*|should\s+be\s*:?[ \t]*|[:=]\s*)" + _SAID + _ENDS,
    "I choose": r"(?i)\b(?:I\s+(?:will\s+)?(?:choose|select|pick)|(?:the\s+)?(?:correct|final|selected)\s+(?:option|choice)\s+is)\s+" + _SAID + _ENDS,
    "the answer X is correct": r"(?i)\banswer\s+['\"]([A-D])[.'\"]*\s+is\s+(?:the\s+)?correct\b",
    "X is the answer": r"(?i)(?:\A|(?<=\n))\s*" + _SAID + r"(?<=\W)is\s+(?:the\s+)?(?:correct|right|best)\s+(?:answer|option|choice|response)\b",
    "a letter alone": r"(?i)\A[\s'\"`*]*([A-D])[\s.'\"`*]*\z",
    "first of two": r"(?i)(?:\A|\banswer\s+is\s+)([A-D])\s+(?:or|and)\s+[A-D]\b",
    "second of two": r"(?i)(?:\A|\banswer\s+is\s+)[A-D]\s+(?:or|and)\s+([A-D])\b",
}
_CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_COMPATIBLE = "ＡＢＣＤａｂｃｄ．：，！？（）［］＜＞／＝　", "ABCDabcd.:,!?()[]<>/= "


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str) -> Column:
    """The first match's letter in a list of one, or an empty list."""
    return F.filter(F.array(F.regexp_extract(text, pattern, 1)), lambda x: x != "")


def _found(letters: Column, scope: str, rule: str) -> Column:
    return F.transform(letters, lambda x: F.struct(F.upper(x).alias("letter"), F.lit(scope).alias("scope"), F.lit(rule).alias("rule")))


def _joined(*lists: Column) -> Column:
    return F.concat(*lists).cast(_CANDIDATE)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _compatible(text: Column) -> Column:
    """Full-width letters and signs as the plain ones; null as empty."""
    return _trimmed(F.translate(F.coalesce(text, F.lit("")), *_COMPATIBLE))


def without_analysis(text: Column) -> Column:
    """The text outside analysis; one that is left open, or a plain "Analysis:", ends where a final answer is announced."""
    bound_ = f"(?={_OPEN_ANSWER}|{_ANNOUNCE})"
    text = F.regexp_replace(text, r"(?is)<analysis\s*>.*?</analysis\s*>", "\n")
    text = F.regexp_replace(text, rf"(?is)\A(.*?)<analysis\s*>(?:.*?{bound_}|.*)", "$1\n")
    return _trimmed(F.regexp_replace(text, rf"(?is)\A\s*(?:analysis|thinking)\s*[:\n](?:.*?{bound_}|.*)", ""))


def explicit_candidates(text: Column) -> Column:
    """Candidates of plainly marked decisions: at the start, in answer fields, announced, in lists of marked choices, "A or B"."""

    def candidates(t: Column) -> Column:
        bodies = F.filter(_all(t, r"(?is)<answer\s*>(.*?)(?=</answer\s*>|\z)"), lambda b: ~b.rlike(r"(?i)<\s*/?\s*(?:analysis|answer)\b"))
        return _joined(
            _found(_first(t, rf"\A\s*{_WHOLE}"), "outside", "at the start"),
            _found(F.flatten(F.transform(bodies, lambda b: _first(b, rf"\A\s*{_WHOLE}"))), "field", "at the start"),
            _found(_all(t, _ANNOUNCE + r"\s*" + _LINE), "outside", "announced"),
            _found(_all(t, r"(?:\A|\n|[,;]\s*|\b(?:or|and|but\s+(?:also\s+)?)\s+)([A-D])[.):](?=\s|\z|\W)"), "outside", "in a list"),
            _found(_all(t, r"\A\s*([A-D])\s+(?:or|and)\s+[A-D]\s*[.!?]?\s*\z"), "outside", "first of two"),
            _found(_all(t, r"\A\s*[A-D]\s+(?:or|and)\s+([A-D])\s*[.!?]?\s*\z"), "outside", "second of two"),
        )

    return bound(without_analysis(_compatible(text)), candidates)


def decision(candidates: Column, letters: Column | str = "ABCD") -> Column:
    """(letter, reason, candidates): the one letter that all candidates name; reasons are none, conflict, and invalid (not among ``letters``)."""
    allowed = F.lit(letters) if isinstance(letters, str) else letters

    def fold(c: Column) -> Column:
        named = F.array_sort(F.array_distinct(F.transform(c, lambda x: x.letter)))
        one = F.get(named, F.lit(0))
        fits = F.instr(allowed, one) > 0
        reason = F.when(F.size(named) == 0, "none").when(F.size(named) > 1, "conflict").when(~fits, "invalid")
        return F.struct(F.when((F.size(named) == 1) & fits, one).alias("letter"), reason.alias("reason"), c.alias("candidates"))

    return bound(candidates, fold)


def explicit_choice(text: Column) -> Column:
    """(letter, reason, candidates) of an answer that marks its choice; explanations are not looked into."""
    return decision(explicit_candidates(text))


def strictly_formatted(text: Column) -> Column:
    """Whether the answer is a letter and nothing else."""
    return F.coalesce(_trimmed(text).rlike(r"\A[A-Da-d]\z"), F.lit(False))


def _answer_fields(text: Column) -> Column:
    """The answer fields as a text of their own, if there are any, else the text outside analysis; option tags are answer tags."""
    text = F.regexp_replace(text, r"(?i)<(/?)option\s*>", "<$1answer>")
    text = F.regexp_replace(text, r"(?is)<analysis\s*>.*?</analysis\s*>", "\n")
    text = F.regexp_replace(text, rf"(?is)\A(.*?)<analysis\s*>(?:.*?(?={_OPEN_ANSWER})|.*)", "$1")
    text = F.regexp_replace(text, r"(?i)(<answer\s*>\s*)(?:option|choice)\s*(?:is\s+|[:=]\s*|(?=[A-D](?!\w)))", "$1")

    def fields(t: Column) -> Column:
        bodies = _all(t, r"(?is)<answer\s*>(.*?)(?=</answer\s*>|\z)")
        return F.when(F.size(bodies) > 0, F.array_join(F.transform(bodies, lambda b: F.concat(F.lit("<answer>"), b, F.lit("</answer>"))), "\n")).otherwise(t)

    return bound(text, fields)


def field_choice(text: Column) -> Column:
    """As :func:`explicit_choice`, but an answer or option field decides alone where there is one."""
    return decision(explicit_candidates(_answer_fields(_compatible(text))))


def _letter_tags(t: Column) -> Column:
    """Candidates of letters as tags: <B>, what such a tag holds, and its closing."""
    return _joined(
        _found(_all(t, r"(?i)<([A-D])\s*>"), "outside", "a letter as tag"),
        _found(_all(t, r"(?i)<[A-D]\s*>\s*([A-D])\s*[.]?\s*(?=</[A-D]\s*>|</answer\s*>|\z)"), "outside", "in a letter tag"),
        _found(_all(t, r"(?i)<[A-D]\s*>[^<>]*</([A-D])\s*>"), "outside", "a letter tag's closing"),
    )


def _recovered(text: Column) -> Column:
    """Candidates of a text without a readable answer field: an analysis that is a letter alone at the end, letter tags, a last line."""
    ending = r"(?is)<analysis\s*>\s*([A-D])\s*[.]?\s*</analysis\s*>\s*[.]?\s*\z"
    rest = F.regexp_replace(F.regexp_replace(text, ending, ""), r"(?is)<analysis\s*>.*?</analysis\s*>", "\n")
    edge = r"(?=<(?:answer|option)\s*>|(?:\A|(?<=\n))\s*(?:<[A-D]\s*>|(?:Final\s+answer|Answer)\s*[:=]\s*[A-D]\s*[.]?\s*\z))"
    rest = F.regexp_replace(rest, rf"(?is)\A(.*?)<analysis\s*>(?:.*?{edge}|.*)", "$1")
    line = r"(?i)(?:\A|\n)\s*(?:(?:Final\s+answer|Answer|Option|Choice)\s*(?:is\s+|[:=]\s*|\s+))?([A-D])\s*[.]?\s*\z"
    return bound(rest, lambda t: _joined(_found(_first(text, ending), "analysis", "a letter alone"), _letter_tags(t), _found(_first(t, line), "outside", "the last line")))


def tagged_choice(text: Column) -> Column:
    """As :func:`field_choice`, and where fields name nothing: solution fields, letters as tags, a last line or a last analysis that is a letter alone."""

    def read(t: Column) -> Column:
        fields = F.regexp_replace(t, r"(?i)<(/?)solution\s*>", "<$1answer>")
        closed = F.array_join(_all(_answer_fields(fields), r"(?is)(<answer>.*?</answer>)"), "\n")
        both = F.struct(explicit_candidates(closed).alias("own"), _recovered(fields).alias("more"), field_choice(t).alias("plain"))

        def choose(x: Column) -> Column:
            plain = F.filter(x.plain.candidates, lambda c: x.plain.letter.isNotNull())
            return F.when(F.size(x.own) > 0, decision(x.own)).when(F.size(x.more) == 0, x.plain).otherwise(decision(F.concat(x.more, plain)))

        return bound(both, choose)

    return bound(_compatible(text), read)


def sentence_candidates(body: Column, scope: str = "field") -> Column:
    """Candidates of what a field says in sentences."""

    def candidates(b: Column) -> Column:
        own = explicit_candidates(F.concat(F.lit("<answer>"), b, F.lit("</answer>")))
        return _joined(*(_found(_all(b, pattern), scope, rule) for rule, pattern in _SENTENCES.items()), own)

    return bound(_trimmed(F.regexp_replace(body, r"(?i)</?(?:p|b|strong|em|span)\s*>", "")), candidates)


def spoken_choice(text: Column) -> Column:
    """As :func:`tagged_choice`, and sentences in final fields, or in a last line that announces the answer, even inside analysis."""

    def read(t: Column) -> Column:
        bodies = _all(t, r"(?is)<(?:answer|option|solution)\s*>(.*?)(?:</(?:answer|option|solution)\s*>|\z)")
        fields = F.flatten(F.transform(bodies, lambda b: sentence_candidates(b)))
        last = r"(?i)(?:\A|\n)\s*((?:Final\s+answer|Answer)\s*(?:is\s+|[:=]\s*)[^\n]*)\n?\z"
        announced = F.regexp_extract(F.regexp_replace(t, r"(?i)(?:\s*</analysis\s*>\s*)+\z", ""), last, 1)
        parts = F.struct(fields.alias("fields"), F.when(announced != "", sentence_candidates(announced, "analysis")).otherwise(F.array().cast(_CANDIDATE)).alias("last"), tagged_choice(t).alias("tagged"))

        def choose(x: Column) -> Column:
            own = F.when(F.size(x.fields) > 0, x.fields).otherwise(x.last)
            earlier = F.filter(x.tagged.candidates, lambda c: x.tagged.letter.isNotNull())  # an earlier reading may contradict, not be replaced
            return F.when(F.size(own) == 0, x.tagged).otherwise(decision(F.concat(own, earlier)))

        return bound(parts, choose)

    return bound(_compatible(text), read)


def outside_parts(text: Column) -> Column:
    """The parts of a text outside analysis, whose tags may nest; empty ones are left out."""
    tokens = F.split(text, r"(?i)(?=</?analysis\s*>)")
    begin = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, token: Column) -> Column:
        move = F.when(token.rlike(r"(?i)\A<analysis\s*>"), 1).when(token.rlike(r"(?i)\A</analysis\s*>"), -1).otherwise(0)
        depth = F.greatest(F.lit(0), state.depth + move)
        own = _trimmed(F.regexp_replace(token, r"(?i)\A</?analysis\s*>", ""))
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(state.parts, F.array(own))).otherwise(state.parts).alias("parts"))

    return F.filter(F.aggregate(tokens, begin, step).parts, lambda p: p != "")


def option_key(text: Column) -> Column:
    """What two spellings of one option share: case, articles, quotes, emphasis, numbers in words, digits or places."""

    def key(t: Column) -> Column:
        bare = F.when(t.rlike(r"^\d{1,3}(?:,\d{3})+$"), F.replace(t, F.lit(","))).otherwise(t)
        place = F.regexp_extract(t, r"^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d+(?=(?:st|nd|rd|th)\b))(?:st|nd|rd|th)?(?:\s+(?:position|place))?$", 1)
        number = F.array_position(F.array(*map(F.lit, _ORDINALS)), place)
        word = F.array_position(F.array(*map(F.lit, _CARDINALS)), t)
        ordinal = F.concat(F.lit("place "), F.when(number > 0, number.cast("string")).otherwise(place.try_cast("int").cast("string")))
        return F.when(word > 0, (word - 1).cast("string")).when(place != "", ordinal).otherwise(bare)

    text = F.lower(_compatible(text))
    text = F.translate(text, "’‘“”–—", "''\"\"--")
    text = F.regexp_replace(F.regexp_replace(text, r"</?(?:p|b|strong|em|span)\s*>", ""), r"\s+", " ")
    text = F.regexp_replace(text, r"\A[\s.!?;:,\"'`*]+|[\s.!?;:,\"'`*]+\z", "")
    return bound(F.regexp_replace(text, r"\A(?:an?|the) ", ""), key)


def _final_parts(text: Column) -> Column:
    """(body, scope) of what may hold the final decision: final fields if there are any, else the text outside analysis, mended."""
    tag, shut = rf"</?(?:{_FIELDS})\s*>|</?analysis\s*>", rf"</(?:{_FIELDS})\s*>"
    part = lambda bodies, scope: F.transform(bodies, lambda b: F.struct(b.alias("body"), F.lit(scope).alias("scope")))
    clean = lambda t: _trimmed(F.regexp_replace(t, rf"(?i){shut}|</analysis\s*>", "\n"))
    alone = r"(?i)\A[A-D][.!?,;:]?\z"

    def outside(parts: Column) -> Column:
        swapped = _all(F.array_join(parts, "\n"), rf"(?i){shut}([^<>]+)(?={shut}|\z)")
        earlier = F.filter(F.transform(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), clean), lambda p: p.rlike(alone))

        def last(tail: Column) -> Column:
            other = F.regexp_extract(tail, r"(?i)\A<(?!(?:[a-d]|analysis)\s*>)([a-z][\w-]*)\s*>\s*([A-D])\s*</\1\s*>\z", 2)
            lines = F.filter(F.transform(F.split(tail, r"\R"), _trimmed), lambda x: (x != "") & (x != "."))
            decided = ~F.contains(tail, F.lit("<")) & F.exists(lines, lambda x: ~x.rlike(alone))
            decided &= F.coalesce(F.element_at(lines, -1).rlike(r"(?i)\A(?:(?:final\s+answer|answer|option|choice)\s*(?:is\s+|[:=]\s*))?[A-D][.!?,;:]?\z"), F.lit(False))
            kept = F.when(decided, F.element_at(lines, -1)).otherwise(tail)
            return F.when(other != "", part(F.array(other), "another tag")).when(kept != "", part(F.array(kept), "outside")).otherwise(F.array().cast("array<struct<body:string,scope:string>>"))

        tail = F.when(F.size(parts) > 0, clean(F.element_at(parts, -1))).otherwise("")
        return F.concat(part(swapped, "a closing tag as opening"), part(earlier, "an earlier part"), bound(tail, last))

    def choose(fields: Column) -> Column:
        return F.when(F.size(fields) > 0, part(fields, "field")).otherwise(bound(outside_parts(text), outside))

    return bound(_all(text, rf"(?is)<(?:{_FIELDS})\s*>(.*?)(?={tag}|\z)"), choose)


def _part_candidates(part: Column, options: Column) -> Column:
    """Candidates of a final part: letters in all their forms, else the options whose text it is."""
    body, outside = part.body, part.scope == "outside"
    none = F.array().cast(_CANDIDATE)
    listed = F.regexp_extract(body, r"(?i)\A[\s,]*([A-D](?:\s*(?:,\s*(?:(?:and|or)\s+)?|/\s*|\s+(?:and|or)\s+)[A-D]\b)+)", 1)
    letters = _joined(
        sentence_candidates(body), _found(_all(listed, r"(?i)\b([A-D])\b"), "field", "a list of letters"),
        F.when(outside, _joined(_found(_all(body, r"(?i)</?([A-D])\s*>"), "outside", "a letter as tag"), _found(_all(body, r"(?i)<[A-D]\s*>\s*([A-D])[.]?\s*</[A-D]\s*>"), "outside", "in a letter tag"))).otherwise(none),
        _found(_all(body, r"(?i)\A[\s'\"`*]*([A-D])[\s.,:;!?'\"`*]*\z"), "field", "a letter alone"), _found(_all(body, r"\A\s*([A-D])\s*[,\-]\s+"), "field", "a letter first"),
        _found(_all(body, r"(?im)^[^\S\n]*(?:(?:option|choice)\s+)?([A-D])[.!?,;:]?[^\S\n]*$"), "field", "a line of its own"),
    )
    said = F.regexp_replace(_trimmed(body), r"(?i)\A(?:(?:the\s+)?(?:correct|final)\s+)?answer\s*(?:is\s*:?[ \t]*|[:=]\s*)", "")

    def by_text(key: Column) -> Column:
        hits = F.filter(F.transform(options, lambda o, i: F.when((key != "") & (option_key(o) == key), F.char(i + 65))), lambda x: x.isNotNull())
        return _found(hits, "field", "an option's text")

    return bound(letters, lambda c: F.when(F.size(c) > 0, c).otherwise(bound(option_key(said), by_text)))


def final_choice(text: Column, options: Column) -> Column:
    """(letter, reason, candidates) of the final decision, by letter or by the text of exactly one of the two to four ``options``.

    As :func:`spoken_choice`, and damaged tags: escaped ones, a closing tag as
    an opening, a letter in a tag of another name, analysis inside analysis.
    The right answer is never looked at.  Null text, or options that are null
    or not two to four, give the reason none.
    """

    def read(t: Column) -> Column:
        own = F.flatten(F.transform(_final_parts(t), lambda p: _part_candidates(p, options)))
        letters = F.substring(F.lit("ABCD"), F.lit(1), F.size(options))
        return bound(F.struct(own.alias("own"), spoken_choice(text).alias("spoken")), lambda x: F.when(F.size(x.own) > 0, decision(x.own, letters)).otherwise(x.spoken))

    usable = F.coalesce(F.size(options).between(2, 4), F.lit(False)) & text.isNotNull()
    nothing = F.struct(F.lit(None).cast("string").alias("letter"), F.lit("none").alias("reason"), F.array().cast(_CANDIDATE).alias("candidates"))
    return F.when(usable, bound(F.regexp_replace(_compatible(text), r"\\([<>/])", "$1"), read)).otherwise(nothing)
