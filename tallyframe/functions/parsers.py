"""Conservative readers of answers in free text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(text: Column) -> Column:
    """Upper-case words of letters, digits and apostrophes with one space between: signs and brackets say nothing here."""
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9']+", " "))


def _single(words: Column) -> Column:
    return F.when(words.rlike("^[A-Z]$"), words)


def tagged(text: Column, name: str) -> Column:
    """(content, n, closed): what the first pair of tags holds, how many tags open and whether each is closed."""
    content = F.regexp_extract(text, rf"(?is)<{name}>(.*?)</{name}>", 1)
    opened, shut = (F.regexp_count(text, F.lit(f"(?i)<{slash}{name}>")) for slash in ("", "/"))
    return F.struct(F.when(F.least(opened, shut) > 0, content).alias("content"), opened.alias("n"), (opened == shut).alias("closed"))


def tag(text: Column, name: str) -> Column:
    """What stands in the first pair of tags of that name; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?is)<{name}>(.*?)</{name}>", 1), F.lit(""))


def announced(text: Column) -> Column:
    """The letters that follow a word of announcing, in order."""
    return F.regexp_extract_all(F.concat(_words(text), F.lit(" ")), F.lit(r"\b(?:ANSWER|OPTION|CHOICE) (?:IS )?([A-Z]) "), F.lit(1))


def answer_letter(text: Column) -> Column:
    """The letter in an answer tag, else the first announced one, else a text that is nothing but a letter; else null."""
    return F.coalesce(_single(_words(tag(text, "answer"))), F.get(announced(text), F.lit(0)), _single(_words(text)))


def one_letter(text: Column, letters: str = "ABCD") -> Column:
    """(letter, reason): the one letter that tags, announcements, boxes and the last line agree on.

    Analysis in tags is left out.  Reasons are none (no candidate) and
    conflict (several different ones); a letter has none.
    """
    open_text = F.regexp_replace(text, r"(?is)<(analysis|think)>.*?</\1>", " ")
    boxed = F.regexp_extract_all(F.upper(open_text), F.lit(r"\\BOXED\{\s*(?:\\TEXT\{)?\s*([A-Z])\s*\}"), F.lit(1))
    last = F.element_at(F.split(F.rtrim(open_text), r"\n"), -1)
    tags = F.transform(F.regexp_extract_all(open_text, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1)), lambda x: _single(_words(x)))
    found = F.array_compact(F.concat(tags, announced(open_text), boxed, F.array(_single(_words(last)))))
    found = F.array_distinct(F.filter(found, lambda x: F.instr(F.lit(letters), x) > 0))
    return F.struct(F.when(F.size(found) == 1, found[0]).alias("letter"), F.when(F.size(found) == 0, "none").when(F.size(found) > 1, "conflict").alias("reason"))


def by_choice_text(text: Column, choices: Column) -> Column:
    """The letter of the only choice that a text repeats; null if none or several are in it."""
    said = F.concat(F.lit(" "), _words(text), F.lit(" "))
    hits = F.filter(F.transform(choices, lambda c, i: F.when(F.contains(said, F.concat(F.lit(" "), _words(c), F.lit(" "))), F.char(i + 65))), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, hits[0])


def loose_letter(text: Column, letters: str = "ABCD") -> Column:
    """The letter in an answer tag, else the first that stands alone in the text."""
    alone = F.nullif(F.regexp_extract(F.upper(text), rf"\b([{letters}])\b", 1), F.lit(""))
    return F.coalesce(_single(_words(tag(text, "answer"))), alone)


def verdict(text: Column) -> Column:
    """(verdict, reason) of a judge's JSON inside prose: YES or NO, else UNCERTAIN with why."""
    raw = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    said = F.upper(F.trim(F.get_json_object(raw, "$.verdict")))
    known = said.isin("YES", "NO")
    reason = F.when(raw.isNull(), "no JSON").when(said.isNull(), "no verdict").when(~known, "unknown verdict")
    return F.struct(F.when(F.coalesce(known, F.lit(False)), said).otherwise("UNCERTAIN").alias("verdict"), reason.alias("reason"))


def both_agree(a: Column, b: Column) -> Column:
    """True for two YES, false for two NO, else null."""
    return F.when((a == "YES") & (b == "YES"), True).when((a == "NO") & (b == "NO"), False)


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS(.f) or MM:SS(.f); null for anything else."""
    fits = F.regexp_like(text, F.lit(r"^\d+(:[0-5]?\d){1,2}(\.\d+)?$"))
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.when(fits, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p))
