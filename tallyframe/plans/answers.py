"""Queries over answers that are written around the rows of a table, and their SQL.

No table holds model answers, so each row writes one: the row's key picks a
wording, its columns the letters, numbers and orders.  What a wording decides
is stated beside it; the SQL knows the wording's number and that decision and
reads no text, so it is no copy of the readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import choices, embedded, open_answers, rules
from .screening import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


#: Wordings with a letter x and another letter y (never x), and what each reader decides: x, y, or - for none, ! for a conflict.
#: Readers: explicit, field, tagged, spoken, final.
WORDINGS = [
    ("{x}. It is so.", "xxxxx"), ("[{x}]", "xxxxx"), ("no idea at all", "-----"), ("A dog is there", "-----"), ("{x} or {y}", "!!!!!"),
    ("{x}. Four.\nFinal answer: {y}.", "!!yyy"), ("<answer>{x}</answer>", "xxxxx"), ("<answer>{x}</answer><answer>{y}</answer>", "!!!!!"),
    ("<analysis>{y}. seems so.</analysis>Final answer: {x}.", "xxxxx"), ("<option>{x}</option>", "-xxxx"), ("{y}. Wrong.<answer>{x}</answer>", "!xxxx"),
    ("<analysis>e</analysis>\n<{x}>", "--xxx"), ("<{x}>{y}</{x}>", "--!!!"), ("<analysis>e</analysis><solution>{x}</solution>", "--xxx"), ("e\n<analysis>{x}</analysis>", "--xxx"),
    ("<answer>The correct answer is {x} because it fits.</answer>", "---xx"), ("<answer>I will choose {x}.</answer>", "---xx"),
    ("<analysis>e.\nAnswer: {x}.</analysis>", "---xx"), ("<analysis>e</analysis> {x} </answer>", "----x"), ("<answer>{text}</answer>", "----x"),
]
_READERS = {"explicit": choices.explicit_choice, "field": choices.field_choice, "tagged": choices.tagged_choice, "spoken": choices.spoken_choice}
#: Texts of the four options.
OPTIONS = ["Happy people", "An angry crowd", "25,000", "the third place"]


def _written(wording: Column, x: Column, y: Column) -> Column:
    """The answer of a row: the wording's text with its letters put in."""
    text = F.get(F.array(*(F.lit(w) for w, _ in WORDINGS)), wording)
    own = F.get(F.array(*map(F.lit, ("happy people.", "Angry crowd", "25000", "3rd place"))), F.ascii(x) - 65)
    return F.replace(F.replace(F.replace(text, F.lit("{x}"), x), F.lit("{y}"), y), F.lit("{text}"), own)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every order: o_orderkey, gold, answer."""
    at = (F.col("o_custkey") % 4).cast("int")
    x, y = F.char(at + 65), F.char((at + 1 + F.col("o_custkey") % 3) % 4 + 65)
    wording = (F.col("o_orderkey") % len(WORDINGS)).cast("int")
    gold = F.char((F.col("o_orderkey") / 32).cast("long") % 4 + 65)
    return table(spark, sf_dir, "orders").select("o_orderkey", gold.alias("gold"), _written(wording, x, y).alias("answer"))


def _decided(reader: int) -> str:
    """SQL of what a reader decides of the row's wording."""
    words = {"x": "x", "y": "y", "-": "'none'", "!": "'conflict'"}
    return "CASE w " + " ".join(f"WHEN {i} THEN {words[d[reader]]}" for i, (_, d) in enumerate(WORDINGS)) + " END"


_WRITTEN = f"""
WITH o AS (
  SELECT o_orderkey, o_orderkey % {len(WORDINGS)} AS w, chr((65 + o_custkey % 4)::INT) AS x, chr((65 + (o_custkey % 4 + 1 + o_custkey % 3) % 4)::INT) AS y,
    chr((65 + (o_orderkey // 32) % 4)::INT) AS gold FROM orders
)"""


def _letter_or_reason(d: Column) -> Column:
    return F.coalesce(d.letter, d.reason)


@query(_WRITTEN + f" SELECT o_orderkey, {', '.join(f'{_decided(i)} AS {n}' for i, n in enumerate(_READERS))} FROM o")
def choices_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four readers of final choices decide of each order's answer."""
    return _answers(spark, sf_dir).select("o_orderkey", *(_letter_or_reason(read(F.col("answer"))).alias(n) for n, read in _READERS.items()))


@query(_WRITTEN + f" SELECT o_orderkey, {_decided(4)} AS final FROM o")
def choices_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader that also knows the options' texts decides."""
    decided = choices.final_choice(F.col("answer"), F.array(*map(F.lit, OPTIONS)))
    return _answers(spark, sf_dir).select("o_orderkey", _letter_or_reason(decided).alias("final"))


@query(_WRITTEN + f""", r AS (SELECT gold, {_decided(0)} AS a, {_decided(3)} AS b FROM o),
l AS (SELECT gold, CASE WHEN length(a) = 1 THEN a END AS a, CASE WHEN length(b) = 1 THEN b END AS b FROM r)
SELECT gold, count(*)::BIGINT AS n, count(a)::BIGINT AS parsed_before, count(b)::BIGINT AS parsed, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL)::BIGINT AS recovered,
  count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL)::BIGINT AS rejected, count(*) FILTER (WHERE a <> b)::BIGINT AS changed,
  count(*) FILTER (WHERE a IS NULL AND b = gold)::BIGINT AS newly_correct, round(avg(CASE WHEN b = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM l GROUP BY gold
""")
def choices_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By right answer: how many decisions a later reader recovers, rejects or changes against the plain one; no decision is wrong."""
    a, b = (read(F.col("answer")).letter for read in (choices.explicit_choice, choices.spoken_choice))
    rows = _answers(spark, sf_dir).select("gold", a.alias("a"), b.alias("b"))
    right = F.coalesce(F.col("b") == F.col("gold"), F.lit(False))
    return rows.groupBy("gold").agg(
        F.count("*").alias("n"), F.count("a").alias("parsed_before"), F.count("b").alias("parsed"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("recovered"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("rejected"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a").isNull() & right).alias("newly_correct"),
        F.round(F.avg(right.cast("double")), 6).alias("accuracy"),
    )


# -- open answers about the lines of orders: a line's quantity as a count, its key as an order of three events ------------

#: Questions, references and answers with n (a count), m (another), p and q (orders of a, b, c), and what the router says: a verdict or a comparison, and a method.
OPEN = [
    ("How many times did it ring?", "{n} times.", "{n}", "true", "count"), ("How many times did it ring?", "{n}", "{n} times", "true", "count"), ("How many times did it ring?", "{n}.", "{m} times.", "n = m", "count"),
    ("How many types of tools were shown?", "{n}", "{n} times.", None, "judge"), ("How many types of tools were shown?", "{n}", "{m} types", "n = m", "count"), ("How many people came?", "{n}", "about {n}", None, "judge"),
    ("How many people came?", "{n}", "{word} people", "true", "count"), ("What order? (a) up. (b) down. (c) left.", "({p0})({p1})({p2})", "{q0} then {q1} then {q2}", "p = q", "event sequence"),
    ("Chronological order? (a) up. (b) down. (c) left.", "{p0}{p1}{p2}", "The order: {q0}. {t0}, {q1}. {t1}, and {q2}. {t2}.", "p = q", "event sequence"), ("What order? (a) up. (b) down. (c) left.", "{p0}, {p1}, {p2}", "{q0}, {q1}", None, "judge"),
    ("Is it red?", "No.", "None of the above", "false", "points at options"), ("Is it red?", "No, blue {n}.", "no blue {n}", "true", "exact"), ("Is it red?", "Yes.", "B.", "false", "invalid"), ("Is it red?", "Yes.", "It is red.", None, "judge"),
]
_ORDERS = ["abc", "acb", "bac", "bca", "cab", "cba"]
_EVENTS = {"a": "up", "b": "down", "c": "left"}


def _open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL")
    n, m = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50 + 1).cast("int")
    orders = F.array(*map(F.lit, _ORDERS))
    p, q = F.get(orders, (F.col("l_partkey") % 6).cast("int")), F.get(orders, (F.col("l_suppkey") % 6).cast("int"))
    tens, units = F.get(F.array(*map(F.lit, open_answers.TENS)), (n / 10).cast("int") - 2), F.get(F.array(*map(F.lit, open_answers.UNITS)), F.when(n < 20, n).otherwise(n % 10))
    word = F.when(n < 20, units).when(n % 10 == 0, tens).otherwise(F.concat_ws("-", tens, units))
    happened = F.create_map(*(F.lit(x) for e in _EVENTS.items() for x in e))
    fill = {"n": n.cast("string"), "m": m.cast("string"), "word": word} | {f"p{i}": F.substring(p, i + 1, 1) for i in range(3)}
    fill |= {f"q{i}": F.substring(q, i + 1, 1) for i in range(3)} | {f"t{i}": happened[F.substring(q, i + 1, 1)] for i in range(3)}

    def written(k: int) -> Column:
        text = F.get(F.array(*(F.lit(row[k]) for row in OPEN)), F.col("w"))
        for name, value in fill.items():
            text = F.replace(text, F.lit(f"{{{name}}}"), value)
        return text

    rows = lines.withColumn("w", ((F.col("l_orderkey") + F.col("l_linenumber")) % len(OPEN)).cast("int"))
    return rows.select("l_returnflag", *(written(k).alias(name) for k, name in enumerate(("question", "reference", "answer"))))


def _open_case(k: int) -> str:
    def said(row: tuple) -> str:
        return ("NULL" if row[3] is None else row[3]) if k == 3 else f"'{row[4]}'"

    return "CASE w " + " ".join(f"WHEN {i} THEN {said(row)}" for i, row in enumerate(OPEN)) + " END"


@query(f"""
WITH l AS (
  SELECT l_returnflag, (l_orderkey + l_linenumber) % {len(OPEN)} AS w, l_quantity::INT AS n, l_partkey % 50 + 1 AS m, l_partkey % 6 AS p, l_suppkey % 6 AS q FROM lineitem WHERE l_orderkey IS NOT NULL
), r AS (SELECT l_returnflag, {_open_case(3)} AS correct, {_open_case(4)} AS method FROM l)
SELECT l_returnflag, method, count(*)::BIGINT AS n, count(*) FILTER (WHERE correct)::BIGINT AS n_correct, count(*) FILTER (WHERE NOT correct)::BIGINT AS n_wrong, count(*) FILTER (WHERE correct IS NULL)::BIGINT AS n_open
FROM r GROUP BY 1, 2
""")
def open_answers_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open answers by method: how many a rule finds right or wrong, and how many a judge must read."""
    r = _open_rows(spark, sf_dir).select("l_returnflag", open_answers.routed(F.col("question"), F.col("reference"), F.col("answer")).alias("r")).select("l_returnflag", "r.*")
    return r.groupBy("l_returnflag", "method").agg(
        F.count("*").alias("n"), F.count_if(F.col("correct")).alias("n_correct"), F.count_if(~F.col("correct")).alias("n_wrong"), F.count_if(F.col("correct").isNull()).alias("n_open")
    )


# -- rule tables over turns, and objects in prose around an event's properties ------------------------------------------

def _phrases() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [(i, r.category, r.confidence, p) for i, r in enumerate(rules.QUESTIONS) for p in r.phrases]
    return ", ".join(f"({i}, {quote(c)}, {f}, {quote(p.split(rules.GAP)[0])}, {quote(p.split(rules.GAP)[-1])}, {rules.GAP in p})" for i, c, f, p in rows)


@query(f"""
WITH p(rule, category, confidence, a, b, gap) AS (VALUES {_phrases()}),
t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9? ]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM conversations),
h AS (SELECT conv_id, turn, rule, category, confidence, count(*) FILTER (WHERE NOT gap) AS n_plain, count(*) AS n_all FROM t JOIN p ON contains(t, a) AND contains(t, b) GROUP BY ALL),
f AS (SELECT conv_id, turn, arg_min(category, rule) AS category, arg_min(confidence, rule) AS confidence, arg_min(CASE WHEN n_plain > 0 THEN n_plain ELSE n_all END, rule) AS n_matched, count(*) AS n_fits FROM h GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(category, 'other') AS category, coalesce(confidence, 0.25)::DOUBLE AS confidence, coalesce(n_matched, 0)::BIGINT AS n_matched, coalesce(n_fits, 0)::BIGINT AS n_fits FROM t LEFT JOIN f USING (conv_id, turn)
""")
def questions_categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's category by the first of ten ordered rules that fits its wording."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = rules.categorized(turns, rules.question_text(F.col("text")), rules.QUESTIONS)
    return found.select("conv_id", "turn", "category", "confidence", F.size("matched").cast("long").alias("n_matched"), F.size("fits").cast("long").alias("n_fits"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS n, CASE event_id % 5 WHEN 1 THEN 'brace' WHEN 3 THEN NULL ELSE props->>'$.k' END AS k FROM events
""")
def embedded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's properties as a JSON object in prose, among nested, fenced and torn ones: how many there are, and the first one's key."""
    at = (F.col("event_id") % 5).cast("int")
    around = F.array(
        F.concat(F.lit("see "), F.col("props"), F.lit(' "end"')), F.concat(F.lit('a {"k": "brace", "x": {"y": "}{"}} b '), F.col("props")), F.concat(F.lit('{"z": 1} or\n```json\n'), F.col("props"), F.lit("\n```")),
        F.lit('{"torn": "no end'), F.concat(F.lit("{not json} but "), F.col("props"), F.lit(' {"torn": {')),
    )
    found = table(spark, sf_dir, "events").select("event_id", embedded.objects(F.get(around, at)).alias("o"))
    return found.select("event_id", F.size("o").cast("long").alias("n"), F.get_json_object(F.get("o", F.lit(0)), "$.k").alias("k"))


#: A judge's answers, and what they say.
JUDGED = [
    ('{"verdict": "YES", "reference_facts": ["a"], "candidate_facts": [], "reason": "same"}', "YES"), ('<think>\n</think>\n```json\n{"verdict": "NO", "reference_facts": [], "candidate_facts": ["b"], "reason": "other"}\n```', "NO"),
    ('{"verdict": "YES"}', "UNCERTAIN"), ("YES", "UNCERTAIN"), ('{"verdict": "MAYBE", "reference_facts": [], "candidate_facts": [], "reason": "x"}', "UNCERTAIN"), ("truncated {", "UNCERTAIN"),
]


@query(f"""
WITH v AS (SELECT event_type, list_value({', '.join(f"'{v}'" for _, v in JUDGED)}) AS v, event_id % {len(JUDGED)} AS i, user_id % {len(JUDGED)} AS j FROM events),
r AS (SELECT event_type, v[i + 1] AS a, v[j + 1] AS b FROM v)
SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE a = 'YES' AND b = 'YES')::BIGINT AS n_right, count(*) FILTER (WHERE a = 'NO' AND b = 'NO')::BIGINT AS n_wrong, count(*) FILTER (WHERE a = 'UNCERTAIN')::BIGINT AS n_uncertain FROM r GROUP BY 1
""")
def judgements_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges' answers on every event: right or wrong only where both say so."""
    said = F.array(*(F.lit(t) for t, _ in JUDGED))
    a, b = (embedded.judgement(F.get(said, (F.col(c) % len(JUDGED)).cast("int")))["verdict"] for c in ("event_id", "user_id"))
    both = table(spark, sf_dir, "events").select("event_type", a.alias("a"), b.alias("b")).withColumn("right", embedded.reviews_agree(F.array("a", "b")))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("right")).alias("n_right"), F.count_if(~F.col("right")).alias("n_wrong"), F.count_if(F.col("a") == "UNCERTAIN").alias("n_uncertain"))
