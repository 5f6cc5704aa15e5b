"""Text scalars: normal forms, labels, choices, redaction, counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words for small numbers, in order.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def plain(text: Column) -> Column:
    """Lower case, letters, digits and question marks only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9? ]", " "), " +", " "))


def comparable(text: Column) -> Column:
    """Lower case with single spaces; punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode compatibility form (NFKC), case folded; null stays null."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def halves(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first mark; without one, all of it and null."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def resolution(text: Column, width: int = 16, height: int = 9) -> Column:
    """(width, height) where a text has one such as 640x360 in it; the default ratio for anything else."""
    part = lambda k: F.regexp_extract(text, r"(\d+)\s*[xX×]\s*(\d+)", k).try_cast("int")
    fits = (part(1) > 0) & (part(2) > 0)
    return F.when(fits, F.struct(part(1).alias("width"), part(2).alias("height"))).otherwise(F.struct(F.lit(width).alias("width"), F.lit(height).alias("height")))


def redact(text: Column, pattern: str, mask: str) -> Column:
    """(text, n): matches masked and their number."""
    return F.struct(F.regexp_replace(text, pattern, mask).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("n"))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def small_count(text: Column) -> Column:
    """The number that a short answer starts with, in digits or as a word up to twenty; a unit may follow."""
    word = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+|[a-z]+)\b", 1)
    named = F.array_position(F.array(*map(F.lit, [*UNITS, "twenty"])), word)
    return F.coalesce(word.try_cast("int"), F.when(named > 0, (named - 1).cast("int")))


def english_integer(words: str) -> int | None:
    """The number that English words name, up to 999,999; null where they do not follow its grammar."""

    def below_thousand(tokens: list[str]) -> int | None:
        total = 0
        if len(tokens) > 1 and tokens[1] == "hundred":
            if tokens[0] not in UNITS[1:10]:
                return None
            total, tokens = 100 * UNITS.index(tokens[0]), tokens[2:]
            if tokens[:1] == ["and"]:
                tokens = tokens[1:] or ["?"]
            if not tokens:
                return total
        if len(tokens) == 1 and tokens[0] in UNITS[total > 0 :]:
            return total + UNITS.index(tokens[0])
        if tokens and tokens[0] in TENS and (len(tokens) == 1 or len(tokens) == 2 and tokens[1] in UNITS[1:10]):
            return total + 20 + 10 * TENS.index(tokens[0]) + (UNITS.index(tokens[1]) if len(tokens) == 2 else 0)
        return None

    tokens = words.lower().replace("-", " ").split()
    if "thousand" not in tokens:
        return below_thousand(tokens)
    at = tokens.index("thousand")
    high, rest = below_thousand(tokens[:at]), tokens[at + 1 :]
    rest = rest[1:] or ["?"] if rest[:1] == ["and"] else rest
    low = below_thousand(rest) if rest else 0
    return None if not high or low is None or (rest and not low) else 1000 * high + low


def bare_choice(choice: Column) -> Column:
    """A choice without its label (A. or A) or A:)."""
    return F.regexp_replace(choice, r"^\s*[A-Za-z]\s*[.):]\s*", "")


def rendered(choices: Column) -> Column:
    """Choices as lines A. ..., B. ..."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")


def repaired(choices: Column, answer: Column, least: int = 3) -> Column:
    """(choices, answer, usable): exact repeats dropped, the answer's letter moved along; not usable below ``least`` choices."""
    kept = F.array_distinct(choices)
    place = F.ascii(answer) - 65
    moved = F.array_position(kept, F.get(choices, place)) - 1
    return F.struct(kept.alias("choices"), F.when(moved >= 0, F.char(moved + 65)).alias("answer"), (F.size(kept) >= least).alias("usable"))


def four_choice_problem(choices: Column, answer: Column) -> Column:
    """Why a row is no question with four different choices and a letter of theirs; null where it is one."""
    return (
        F.when(choices.isNull(), "no choices").when(F.size(choices) != 4, "not four choices").when(F.exists(choices, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""), "empty choice")
        .when(F.size(F.array_distinct(F.transform(choices, comparable))) < 4, "repeated choice").when(~F.coalesce(answer.rlike("^[A-D]$"), F.lit(False)), "no answer letter")
    )


def shortened(text: Column, most: int = 120) -> Column:
    """The first words, cut after the last sentence end if that lies past half of them."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, most), " ")
    whole = F.regexp_extract(head, r"^(.*[.!?])(?: |$)", 1)
    return F.when(F.size(words) <= most, F.array_join(words, " ")).when(F.size(F.split(whole, " ")) * 2 > most, whole).otherwise(head)


def screened(text: Column, pattern: str) -> Column:
    """Distinct matches in lower case, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))))


def refers_to_options(text: Column) -> Column:
    """Whether a question's wording needs its options."""
    return F.lower(text).rlike(r"\b(which of|following|options?|choices?|above|below)\b")
