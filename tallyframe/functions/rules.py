"""Ordered rule tables over texts: every phrase of every rule found in one Aho-Corasick pass."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import plain

#: In a phrase: anything between its two parts, in any order.
GAP = ".*"


@dataclass(frozen=True)
class Rule:
    """A category, the phrases that speak for it, and how sure that is."""

    category: str
    phrases: tuple[str, ...]
    confidence: float = 1.0


@functools.lru_cache(8)
def _machine(rules: tuple[Rule, ...]) -> ahocorasick.Automaton:
    """All parts of all phrases, each with a number."""
    machine = ahocorasick.Automaton()
    for part in {p for r in rules for phrase in r.phrases for p in phrase.split(GAP) if p}:
        machine.add_word(part, part)
    machine.make_automaton()
    return machine


def _matched(text: str, rules: tuple[Rule, ...]) -> list[tuple[Rule, list[str]]]:
    """The rules with a phrase in the text, in order, with those phrases; phrases with a gap count only where no plain one of the rule does."""
    there = {part for _, part in _machine(rules).iter(text)}
    out = []
    for rule in rules:
        hits = [p for p in rule.phrases if GAP not in p and p in there]
        hits = hits or [p for p in rule.phrases if GAP in p and all(x in there or not x for x in p.split(GAP))]
        if hits:
            out.append((rule, hits))
    return out


def categorized(df: DataFrame, text: Column, rules: list[Rule], other: str = "other", other_confidence: float = 0.25) -> DataFrame:
    """``df`` with category, confidence, matched (phrases of the first rule that fits) and fits (categories of all rules that do).

    ``text`` must be in the phrases' case.  A null text fits no rule.  The
    rules are a list that travels with the tasks; a text is passed once,
    however many phrases they have.  Columns of ``df`` of these names are
    replaced.
    """
    rules_ = tuple(rules)
    names = [c for c in df.columns if c not in ("category", "confidence", "matched", "fits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_matched(t or "", rules_) if t else [] for t in pc.fill_null(batch.column("__text"), "").to_pylist()]
            first = [f[0] if f else (Rule(other, (), other_confidence), []) for f in found]
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([r.category for r, _ in first], pa.string()), pa.array([float(r.confidence) for r, _ in first]), pa.array([m for _, m in first], pa.list_(pa.string())), pa.array([[r.category for r, _ in f] for f in found], pa.list_(pa.string()))],
                names=[*names, "category", "confidence", "matched", "fits"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    return df.select(*names, text.alias("__text")).mapInArrow(run, f"{kept}, category string, confidence double, matched array<string>, fits array<string>")


def flags(checks: dict[str, tuple[Column, str]]) -> Column:
    """(name, severity) of every check that holds, in order: {name: (condition, severity)}; a null condition does not hold."""
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, (c, s) in checks.items()))
    return F.array_compact(found)


# What a question's wording says about it, before any answer is seen; the first rule that fits decides.
QUESTIONS = [
    Rule("ocr", ("read", "written", "text", "letter", "word", "sign", "logo", "label", "title", "caption", "screen", "display", "number on", "what does it say", "what is written"), 0.95),
    Rule("counting", ("how many", "how much", "number of", "count", "counted", "how often", "how many times", "once", "twice"), 0.95),
    Rule("causal", ("why ", "why?", "reason", "because", "purpose", "so that", "in order to"), 0.93),
    Rule("before_after", (" before ", " after ", "before?", "after?", "what happens next", "what did .* do next", "following", "prior to", "subsequent"), 0.92),
    Rule("temporal_order", ("which happened first", "what happened first", "first or", "in what order", "sequence", "order of events", "earlier or later", "at the beginning", "in the middle", "towards the end"), 0.88),
    Rule("dialogue", ("say", "said", "tell", "told", "ask", "asked", "talk", "talking", "speak", "speaking", "conversation", "dialogue", "sound", "hear", "voice", "speaker", "music", "sing", "shout", "noise"), 0.88),
    Rule("state_change", ("change", "become", "turn into", "start", "stop", "no longer", "end up", "before and after", "put on", "take off", "open", "close", "appear", "disappear"), 0.82),
    Rule("attribute", ("color", "colour", "wear", "wearing", "shirt", "dress", "size", "shape", "material", "appearance", "look like", "which one is", "bigger", "smaller", "longer", "shorter", "same color"), 0.84),
    Rule("object", ("what is", "which object", "which item", "which thing", "what object", "what item", "who is", "where is", "where are", "which person", "which animal", "what kind of"), 0.70),
    Rule("action", ("what did", "what does", "what do", "what is .* doing", "how did", "how does", "how are", "what happened", "what are .* doing"), 0.62),
]


def question_text(question: Column, choices: Column | None = None) -> Column:
    """A question and its choices as the rules read them: lower-case letters, digits and question marks, single spaces."""
    text = plain(F.coalesce(question, F.lit("")))
    return text if choices is None else F.trim(F.concat_ws(" ", text, F.array_join(F.transform(choices, plain), " ")))
