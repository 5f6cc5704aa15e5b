"""JSON objects inside prose: a bracket scan over Arrow batches, and what judges say in them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: All that moves the scan: outside strings brackets and quotes, inside them escapes and quotes.
_OUTSIDE, _INSIDE = re.compile(r'["{}]'), re.compile(r'\\.?|"', re.S)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every balanced {...} that is in no other one, outside strings; brackets in strings do not count, a torn end opens nothing."""
    out, depth, start, at = [], 0, 0, 0
    while m := _OUTSIDE.search(text, at):
        at = m.end()
        if m[0] == '"':
            while (q := _INSIDE.search(text, at)) and q[0] != '"':
                at = q.end()
            at = q.end() if q else len(text)
        elif m[0] == "{":
            start = start if depth else m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((start, at))
    return out


def _objects(text: str | None) -> list[str]:
    """The texts of all JSON objects, those in code fences first; what does not parse as an object is left out."""
    found: dict[str, None] = {}
    for part in [*_FENCE.findall(text or ""), text or ""]:
        for a, b in spans(part):
            try:
                if isinstance(json.loads(part[a:b]), dict):
                    found.setdefault(part[a:b])
            except (ValueError, RecursionError):
                continue
    return list(found)


@F.pandas_udf(ArrayType(StringType()))
def objects(text: pd.Series) -> pd.Series:
    """The JSON objects in a text, in order, each once (those in code fences first); null has none."""
    return text.map(_objects)


def first_object(text: Column) -> Column:
    """The first JSON object in a text; null without one."""
    return F.get(objects(text), F.lit(0))


def judgement(text: Column) -> Column:
    """(verdict, reason) of a judge's answer, which must be one JSON object and nothing else but an empty think tag or a code fence.

    The verdict is UNCERTAIN, with why, unless it is YES, NO or UNCERTAIN and
    both lists of facts and a reason are there.
    """
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?is)\A<think>\s*</think>\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    whole = F.transform(F.array(bare), lambda t: F.from_json(t, "verdict string, reference_facts array<string>, candidate_facts array<string>, reason string, _corrupt_record string", {"mode": "PERMISSIVE"}))[0]
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.try_parse_json(bare), f"$.{name}", "variant"))
    broken = F.try_parse_json(bare).isNull() | ~bare.startswith("{")
    lists = F.coalesce(kind("reference_facts").startswith("ARRAY") & kind("candidate_facts").startswith("ARRAY"), F.lit(False))
    said = F.coalesce((kind("reason") == "STRING") & (F.trim(whole["reason"]) != ""), F.lit(False))
    reason = (
        F.when(F.coalesce(broken, F.lit(True)), "unparseable").when(~F.coalesce((kind("verdict") == "STRING") & whole["verdict"].isin("YES", "NO", "UNCERTAIN"), F.lit(False)), "no such verdict")
        .when(~(lists & said), "no evidence")
    )
    return F.struct(F.when(reason.isNull(), whole["verdict"]).otherwise("UNCERTAIN").alias("verdict"), reason.alias("reason"))


def reviews_agree(reviews: Column) -> Column:
    """True for exactly two YES, false for exactly two NO, null for anything else; ``reviews`` is a list of verdicts."""
    two = F.size(reviews) == 2
    return F.when(two & F.forall(reviews, lambda v: F.coalesce(v == "YES", F.lit(False))), True).when(two & F.forall(reviews, lambda v: F.coalesce(v == "NO", F.lit(False))), False)
