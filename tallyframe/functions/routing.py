"""Where a reviewed or unread answer goes next, as Column expressions; several reasons may hold at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound

# What judges write about references and answers that cannot be compared.
_REFERENCE_WORDS = r"insufficient|undefined|not defined|not provided|missing mapping|cannot map|ambiguous reference"
_ANSWER_WORDS = r"unclear|vague|ambiguous|cannot interpret"
PROTOCOL = ("unparseable", "no such verdict", "no evidence")


def unresolved_reasons(reviews: Column, manual_reference: Column) -> Column:
    """Why an answer is still open, of its ``reviews`` (verdict, reason) and whether its reference needs a check by hand; "semantic review" if nothing else."""

    def reasons(r: Column) -> Column:
        verdicts = F.transform(r, lambda x: x["verdict"])
        text = F.lower(F.array_join(F.transform(r, lambda x: F.coalesce(x["reason"], F.lit(""))), " "))
        rules = {
            "reference by hand": F.coalesce(manual_reference, F.lit(False)), "reviewers disagree": F.array_contains(verdicts, "YES") & F.array_contains(verdicts, "NO"),
            "judge's form": F.exists(r, lambda x: F.coalesce(x["reason"].isin(*PROTOCOL), F.lit(False))), "reference may not suffice": text.rlike(_REFERENCE_WORDS), "answer is ambiguous": text.rlike(_ANSWER_WORDS), "no judge yet": F.size(r) == 0,
        }
        return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items())))

    held = F.coalesce(reviews, F.array().cast("array<struct<verdict:string,reason:string>>"))
    return bound(bound(held, reasons), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("semantic review"))))


def unread_kind(response: Column, conflict: Column) -> Column:
    """What an answer without a decision looks like: conflicting or invalid choices, text without an option, an empty or malformed final field, none."""
    text = F.coalesce(response, F.lit(""))

    def kind(bodies: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(text, r"(?is)<analysis\s*>.*?</analysis\s*>", ""), r"\A\s+|\s+\z", "")
        shown = F.exists(bodies, lambda b: F.trim(F.regexp_replace(b, "<[^>]*>", "")) != "")
        return (
            F.when(F.coalesce(conflict, F.lit(False)) | F.exists(bodies, lambda b: b.rlike(r"\A[A-D](?:\s*[,/&]?\s*[A-D])+[.,]?\z")), "conflicting choices")
            .when(F.exists(bodies, lambda b: b.rlike(r"\A[E-Z][.]?\z")), "invalid choice").when((F.size(bodies) > 0) & shown, "text without an option").when(F.size(bodies) > 0, "empty field")
            .when(rest.rlike(r"(?i)<(?!/?analysis\b)[^<>\n]{0,90}>?\s*\z"), "malformed tag").otherwise("no field")
        )

    found = F.regexp_extract_all(text, F.lit(r"(?is)<(?:answer|option|solution)\s*>(.*?)(?:</(?:answer|option|solution)\s*>|\z)"), F.lit(1))
    return bound(F.transform(found, lambda b: F.regexp_replace(b, r"\A\s+|\s+\z", "")), kind)


def old_answer(choices: Column, answer: Column, gold: Column, original_text: Column, valid: Column) -> Column:
    """What an answer that was given before its choices were repaired is worth: by the text of its letter, not the letter."""
    place = F.ascii(answer) - 65
    text = F.when(F.length(answer) == 1, F.get(choices, place))
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "question was invalid").when(text.isNull(), "no valid answer").when(text != original_text, "another text").when(F.coalesce(answer == gold, F.lit(False)), "same text, same letter").otherwise("same text, another letter")
    )


def final_state(repaired: Column, original: Column, renamed: dict[str, str]) -> Column:
    """The repair's status where there is one, else the original's, under its new name."""
    status = F.coalesce(repaired, original)
    names = F.create_map(*(F.lit(x) for p in renamed.items() for x in p))
    return F.coalesce(F.try_element_at(names, status), status)


def regraded(automatic: Column, reviewed: Column, evidence: Column, insufficient: Column) -> Column:
    """A grade with everything known: null where the reference does not suffice, else the review's if it rests on evidence, else the automatic one.

    A review with evidence that contradicts an automatic grade raises, as one
    of them must be wrong.
    """
    firm = reviewed.isNotNull() & F.coalesce(evidence, F.lit(False))
    clash = firm & automatic.isNotNull() & (reviewed != automatic)
    error = F.raise_error(F.lit("a review contradicts an automatic grade")).cast("boolean")
    return F.when(F.coalesce(insufficient, F.lit(False)), F.lit(None).cast("boolean")).when(clash, error).when(firm, reviewed).otherwise(automatic)
