"""Queries over the driver tables: scoring, spans and budgets of samples, texts and times, checks, splits.

Where a table has no column of the kind an operator reads, the query derives
one from the rows (spans from the lines of an order, clock texts from event
times); the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsers, text, times
from ..functions.columns import steady_mean
from ..operators import budgets, checks, controls, resample, scoring, splits
from .screening import _GRADED, _VIEWS, _graded, _pairs, r6, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- spans of an order's lines: line k has (10 k, 10 k + quantity) ------------------------------------------------------

_ORDER_SPANS = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE AS s, l_linenumber * 10.0::DOUBLE + max(l_quantity) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.max("l_quantity").alias("q"))
    one = controls.span(F.col("l_linenumber") * 10.0, F.col("l_linenumber") * 10.0 + F.col("q"))
    return lines.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("spans"))  # an order has few lines


@query(_ORDER_SPANS + """
, r AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS island FROM r),
u AS (SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, island)
SELECT k, count(*)::BIGINT AS n, sum(e - s) AS seconds, min(s) AS first_s, max(e) AS last_e FROM u GROUP BY k
""")
def spans_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's spans merged; their number, length and hull."""
    m = _order_spans(spark, sf_dir).withColumn("spans", controls.merged(F.col("spans"))).withColumn("h", controls.hull(F.col("spans")))
    return m.select("k", F.size("spans").cast("long").alias("n"), controls.total(F.col("spans")).alias("seconds"), F.col("h.s").alias("first_s"), F.col("h.e").alias("last_e"))


@query(_ORDER_SPANS + """
, j AS (SELECT k, greatest(0, s - 0.25 * (e - s)) AS s1, least(100, e + 0.25 * (e - s)) AS e1, least(100, e - 0.25 * (e - s)) AS e2, s + 0.25 * (e - s) AS s2, greatest(0, s - 0.5 * (e - s)) AS s3, e - 0.5 * (e - s) AS e3 FROM l)
SELECT k, round(sum(e1 - s1) FILTER (WHERE e1 > s1), 6) AS expanded, round(sum(e2 - s2) FILTER (WHERE e2 > s2), 6) AS shrunk, round(sum(e3 - s3) FILTER (WHERE e3 > s3), 6) AS moved_left FROM j GROUP BY k
""")
def spans_jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of an order's spans after three jitters inside 100 seconds."""
    d = F.lit(100.0)
    kinds = {"expanded": "expand", "shrunk": "shrink", "moved_left": "left"}
    return _order_spans(spark, sf_dir).select("k", *(r6(controls.total(controls.jittered(F.col("spans"), kind, 0.5, d))).alias(name) for name, kind in kinds.items()))


@query(_ORDER_SPANS + """
, t AS (SELECT k, count(*) AS n, sum(e - s) AS whole FROM l GROUP BY k), o AS (SELECT k, s, e - s AS size, row_number() OVER (PARTITION BY k ORDER BY s) AS i, coalesce(sum(e - s) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT o.k, i::INT AS i, round((400 - whole) / (n + 1) * i + before, 6) AS s, round((400 - whole) / (n + 1) * i + before + size, 6) AS e FROM o JOIN t USING (k) WHERE whole <= 400
""")
def spans_evenly_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control for each order: spans of the same lengths at equal gaps in 400 seconds."""
    placed = _order_spans(spark, sf_dir).select("k", F.posexplode(controls.evenly_placed(F.col("spans"), F.lit(400.0))).alias("i", "x"))
    return placed.select("k", (F.col("i") + 1).alias("i"), r6("x.s").alias("s"), r6("x.e").alias("e"))


@query(_ORDER_SPANS + """
, o AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s) AS after FROM l)
SELECT k, CASE WHEN bool_or(e > 100) THEN 'outside' WHEN bool_or(coalesce(after < e, false)) THEN 'overlap or order' END AS problem, bool_or(coalesce(after < e, false)) AS overlap FROM o GROUP BY k
""")
def spans_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of an order's spans in 100 seconds."""
    s = F.col("spans")
    return _order_spans(spark, sf_dir).select("k", controls.problem(s, F.lit(100.0)).alias("problem"), controls.neighbours_overlap(s).alias("overlap"))


@query(_ORDER_SPANS + """
, p AS (SELECT unnest([0.0, 30.0, 60.0]) AS ps, unnest([30.0, 60.0, 90.0]) AS pe, unnest([1000.0, 5000.0, 2000.0]) AS origin)
SELECT k, count(*)::INT AS n, round(sum(greatest(s, ps) - ps + origin), 6) AS starts, round(sum(least(e, pe) - greatest(s, ps)), 6) AS seconds FROM l JOIN p ON greatest(s, ps) < least(e, pe) GROUP BY k
""")
def spans_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's spans in the times of the three sources that a montage is made of."""
    pieces = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(a).alias("at")) for s, e, a in ((0.0, 30.0, 1000.0), (30.0, 60.0, 5000.0), (60.0, 90.0, 2000.0))))
    m = _order_spans(spark, sf_dir).select("k", controls.remapped(F.col("spans"), pieces).alias("m"))
    return m.filter(F.size("m") > 0).select("k", F.size("m").alias("n"), r6(F.aggregate("m", F.lit(0.0), lambda a, x: a + x["s"])).alias("starts"), r6(controls.total(F.col("m"))).alias("seconds"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_quantity + l_linenumber AS e FROM lineitem), g AS (SELECT *, least(greatest(e - s, 4.0), 6.0) AS n FROM w)
SELECT l_orderkey, l_linenumber, greatest(0, least(s, 40 - n)) AS s, greatest(0, least(s, 40 - n)) + n AS e FROM g
""")
def view_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 4 to 6 seconds inside 40 for every line (quantity on)."""
    w = controls.window(F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber"), 4.0, 6.0, F.lit(40.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", "w.s", "w.e")


@query("""
WITH p AS (SELECT p_partkey, p_size + 7 AS n FROM part), i AS (SELECT p_partkey, n, unnest(range(0, 8)) AS i FROM p)
SELECT p_partkey, string_agg(round_even(i * (n - 1) / 7, 0)::INT, ',' ORDER BY i) AS frames, (n // 2 * 2)::BIGINT AS even_n FROM i GROUP BY p_partkey, n
""")
def frames_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames spread over as many as a part's size and seven."""
    n = F.col("p_size") + 7
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(controls.spread(n, 8).cast("array<string>"), ",").alias("frames"), controls.even_floor(n).alias("even_n"))


# -- budgets -----------------------------------------------------------------------------------------------------------

@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT k, count(*) AS n, sum(w) AS whole FROM l GROUP BY k),
x AS (SELECT l.k, i, n, floor((32 - n) * w / whole + 1e-9) AS given, round((32 - n) * w / whole - floor((32 - n) * w / whole + 1e-9), 9) AS rest FROM l JOIN n USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rest DESC, i) AS place, 32 - n - sum(given) OVER (PARTITION BY k) AS left_over FROM x)
SELECT k, i, (2 * (given + 1 + CASE WHEN place <= left_over THEN 1 ELSE 0 END))::BIGINT AS frames FROM r
""")
def frame_pairs_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 frames over an order's lines by quantity, in pairs, one pair at least."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("w"))
    sets = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x"))
    shares = budgets.allocation(F.transform("x", lambda x: x["w"]), F.lit(64), 1, 2)
    return sets.select("k", F.explode(F.arrays_zip(F.transform("x", lambda x: x["i"]).alias("i"), shares.alias("frames"))).alias("z")).select("k", "z.i", F.col("z.frames").cast("long").alias("frames"))


@query("""
WITH d AS (SELECT event_id, value * 40 AS d FROM events), a AS (SELECT event_id, d, (ceil(least(d, 300) * 25) + 64)::BIGINT AS audio FROM d), v AS (SELECT *, least(24000, 32768 - 2048 - 512 - audio) AS visual FROM a)
SELECT event_id, audio, visual::BIGINT AS visual, greatest(2, floor(least(d * 2, 300, visual / 100) / 2) * 2)::BIGINT AS frames FROM v
""")
def dynamic_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio, visual tokens and frames of spans of forty times an event's value, in seconds."""
    d = F.col("value") * 40
    rows = table(spark, sf_dir, "events").select("event_id", d.alias("d"), budgets.audio_tokens(d).alias("audio")).withColumn("visual", budgets.visual_tokens(F.col("audio")).cast("long"))
    return rows.select("event_id", "audio", "visual", budgets.frames(F.col("d"), F.col("visual")).alias("frames"))


@query("""
WITH g AS (SELECT p_partkey, 20.0 * p_size + 40 AS t, 1 + (p_partkey % 7) / 4.0 AS r, unnest(range(1, 49)) AS h FROM part),
w AS (SELECT *, greatest(1, least(48, floor(t / h), floor(h * r + 0.5)))::INT AS w FROM g), e AS (SELECT *, round(abs(w / h - r) / r + 4 * abs(t - w * h) / t, 9) AS error FROM w WHERE w * h <= t)
SELECT p_partkey, h::INT AS h, w FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY error, h, w) = 1
""")
def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch grid for a part's tokens and ratio, both derived from its size and key."""
    t, r = F.col("p_size") * 20.0 + 40, 1 + (F.col("p_partkey") % 7) / 4.0
    return table(spark, sf_dir, "part").select("p_partkey", budgets.grid(t, r).alias("g")).select("p_partkey", "g.h", "g.w")


# -- texts, times, choices ---------------------------------------------------------------------------------------------

@query("""
SELECT event_id, (CASE event_id % 3 WHEN 0 THEN second(ts) WHEN 1 THEN minute(ts) * 60 + second(ts) ELSE hour(ts) * 3600 + minute(ts) * 60 + second(ts) END)::DOUBLE AS seconds,
  (CASE event_id % 3 WHEN 1 THEN minute(ts) * 60 + second(ts) WHEN 2 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END)::DOUBLE AS strict FROM events
""")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written as SS, MM:SS or HH:MM:SS and read back by both readers."""
    clock = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "mm:ss")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", clock.alias("c")).select("event_id", times.seconds(F.col("c")).alias("seconds"), times.strict_seconds(F.col("c")).alias("strict"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS a, l_linenumber * 12 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN a < b THEN 1 ELSE 0 END + CASE WHEN b < a + 30 THEN 1 ELSE 0 END)::INT AS n, least(CASE WHEN a < b THEN a END, CASE WHEN b < a + 30 THEN b END)::DOUBLE AS first_s, a < b AND b < a + 30 AS only_ranges FROM l
""")
def ranges_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges written as text from a line's numbers, read back; the second reader takes texts of ranges alone."""
    a, b = F.col("l_quantity").cast("int"), F.col("l_linenumber") * 12
    written = F.concat(F.lit("["), a.cast("string"), F.lit(" - "), b.cast("string"), F.lit("]; "), b.cast("string"), F.lit("–0:"), (a + 30).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", written.alias("t")).withColumn("r", times.read_ranges(F.col("t"), F.lit(1e9)))
    return rows.select("l_orderkey", "l_linenumber", F.size("r.spans").alias("n"), F.get("r.spans", F.lit(0))["s"].alias("first_s"), F.col("r.alone").alias("only_ranges"))


@query(r"""
SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9? ]', ' ', 'g'), ' +', ' ', 'g')) AS plain, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS comparable,
  regexp_matches(lower(text), '\b(which of|following|options?|choices?|above|below)\b') AS needs_options FROM benchmark
""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.plain(t).alias("plain"), text.comparable(t).alias("comparable"), text.refers_to_options(t).alias("needs_options"))


@query("""
WITH c AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag || l_linestatus ORDER BY l_returnflag || l_linestatus) AS kept, arg_min(l_returnflag || l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS right_one FROM lineitem GROUP BY 1)
SELECT k, len(kept)::INT AS n, len(kept) >= 3 AS usable, right_one AS answer_text FROM c
""")
def options_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line states as choices: repeats dropped, the first line's as answer, found again after its letter has moved."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("c"))
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("x"))
    fixed = sets.select("k", text.repaired(F.transform("x", lambda x: x["c"]), F.lit("A")).alias("r"))
    return fixed.select("k", F.size("r.choices").alias("n"), "r.usable", F.get("r.choices", F.ascii("r.answer") - 65).alias("answer_text"))


@query("""
SELECT p_partkey, 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type AS rendered, p_brand AS bare, split_part(p_name, ' ', 1) AS first_half, nullif(substr(p_name, length(split_part(p_name, ' ', 1)) + 2), '') AS second_half,
  regexp_extract(p_brand, '[0-9]+')::DOUBLE AS number, regexp_replace(p_brand, '[0-9]', '#', 'g') AS redacted, length(regexp_replace(p_brand, '[^0-9]', '', 'g'))::INT AS n_redacted FROM part
""")
def labels_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices from a part's columns: rendered, label stripped, split, a number read, digits masked."""
    first, second = text.halves(F.col("p_name"), " ")
    masked = text.redact(F.col("p_brand"), "[0-9]", "#")
    bare = text.bare_choice(F.concat(F.lit("B) "), F.col("p_brand")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.rendered(F.array("p_name", "p_brand", "p_type")).alias("rendered"), bare.alias("bare"), first.alias("first_half"), second.alias("second_half"),
        text.first_number(F.col("p_brand")).alias("number"), masked["text"].alias("redacted"), masked["n"].alias("n_redacted"),
    )


@query("""
WITH a AS (SELECT conv_id, turn, chr((65 + turn % 4)::INT) AS x, chr((65 + conv_id % 4)::INT) AS y FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN x WHEN 1 THEN CASE WHEN x = y THEN x END END AS letter, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN x <> y THEN 'conflict' END ELSE 'none' END AS reason FROM a
""")
def one_letter_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written around turns in three forms, read by the reader that wants all signs to agree."""
    x, y = F.char(F.col("turn") % 4 + 65), F.char(F.col("conv_id") % 4 + 65)
    written = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>the answer is "), y, F.lit("</think>\nso the final answer: ["), x, F.lit("]")))
    written = written.when(F.col("turn") % 3 == 1, F.concat(F.lit("<answer>("), x, F.lit(")</answer> or option "), y, F.lit("."))).otherwise(F.lit("no idea at all"))
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", parsers.one_letter(written).alias("r"))
    return rows.select("conv_id", "turn", "r.letter", "r.reason")


# -- scoring and comparisons -------------------------------------------------------------------------------------------

@query(_GRADED + """
SELECT lang, source, count(*) AS n, count(quality) AS evaluated, count(*) FILTER (WHERE correct) AS n_correct, round(avg(correct::INT), 6) AS accuracy, round(avg(n_chars), 6) AS mean_n_chars FROM g GROUP BY 1, 2
""")
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.group_metrics(_graded(spark, sf_dir), ["lang", "source"], "correct", ["n_chars"])
    return out.withColumns({"accuracy": r6("accuracy"), "mean_n_chars": r6("mean_n_chars")})


@query("""
WITH r AS (SELECT doc_id, CASE WHEN max(n_chars) % 3 > 0 THEN max(n_chars) % 2 END AS p FROM documents GROUP BY 1), l AS (SELECT doc_id, max(quality) AS a FROM labels GROUP BY 1)
SELECT count(*) AS n, count(p) AS parsed, count(*) FILTER (WHERE coalesce(p = a, false)) AS n_correct, count(*) FILTER (WHERE p IS NULL AND coalesce(p = a, false)) AS unparsed_correct FROM r JOIN l USING (doc_id)
""")
def results_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up predictions from text lengths against labels: what is not parsed counts as wrong."""
    found = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("m")).select("doc_id", F.when(F.col("m") % 3 > 0, F.col("m") % 2).alias("p"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("a"))
    rows = scoring.graded(found, labels, "doc_id", "p", "a", strict=False)
    return rows.agg(F.count("*").alias("n"), F.count_if("parsed").alias("parsed"), F.count_if("correct").alias("n_correct"), F.count_if(~F.col("parsed") & F.col("correct")).alias("unparsed_correct"))


@query("""
WITH u AS (SELECT c_name, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS m FROM customer GROUP BY 1), w AS (SELECT c_nationkey * 1000 + c_custkey % 50 AS p, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS m FROM customer GROUP BY 1)
SELECT o_orderkey, coalesce(u.m, w.m) AS matched FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS name, o_custkey % 25 * 1000 + o_orderkey % 50 AS p FROM orders) o
LEFT JOIN u ON u.c_name = o.name LEFT JOIN w ON w.p = o.p
""")
def fallback_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders matched with customers by name, else by a second key that only some customers have to themselves."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 50).alias("p"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), (F.col("o_custkey") % 25 * 1000 + F.col("o_orderkey") % 50).alias("p"))
    return scoring.by_ladder(orders, customers, ["name", "p"], "c_custkey").select("o_orderkey", "matched")


@query("""
WITH m AS (SELECT l_suppkey, avg(l_discount) FILTER (WHERE l_linenumber = 1) AS initial, avg(l_discount) FILTER (WHERE l_linenumber = 2) AS cur, avg(l_discount) FILTER (WHERE l_linenumber = 3) AS teacher FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN abs(teacher - initial) > 0.005 THEN round((cur - initial) / (teacher - initial), 4) END AS recovery FROM m
""")
def gap_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 1, 2 and 3 of a supplier as initial model, current one and teacher."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(steady_mean(F.col("l_discount")).alias("mean"))
    arm = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("mean")))
    m = means.groupBy("l_suppkey").agg(arm(1).alias("a"), arm(2).alias("b"), arm(3).alias("c"))
    return m.select("l_suppkey", F.round(scoring.gap_recovery(F.col("b"), F.col("a"), F.col("c"), 0.005), 4).alias("recovery"))


@query(_VIEWS + """
SELECT CASE WHEN delta_correct IS NULL THEN 'ineligible' WHEN delta_correct = 1 THEN 'A' WHEN delta_correct = 0 THEN 'B' ELSE 'C' END AS flip_tier,
  CASE WHEN NOT base_correct AND other_correct THEN 1 WHEN other_correct AND delta_p > 0 AND base_p >= 0.05 THEN 2 WHEN other_correct AND delta_p > 0 THEN 3 ELSE 99 END AS positive_tier,
  CASE WHEN base_correct AND other_correct THEN 'both' WHEN base_correct THEN 'base_only' WHEN other_correct THEN 'other_only' ELSE 'both_wrong' END AS views, count(*) AS n FROM pairs GROUP BY ALL
""")
def policy_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two more tier policies and which view is right, counted over the paired lines."""
    b, o = F.col("base_correct"), F.col("other_correct")
    tiers = [scoring.flip_tier(F.col("delta_correct")).alias("flip_tier"), scoring.positive_tier(b, o, F.col("delta_p"), F.col("base_p") < 0.05).alias("positive_tier"), scoring.complement(b, o, ("base", "other")).alias("views")]
    return _pairs(spark, sf_dir).groupBy(*tiers).agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT l_suppkey, l_linenumber, max(l_discount) AS p FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4) GROUP BY 1, 2)
SELECT l_suppkey, max(p) FILTER (WHERE l_linenumber = 1) AS "1", max(p) FILTER (WHERE l_linenumber = 2) AS "2", max(p) FILTER (WHERE l_linenumber = 3) AS "3", max(p) FILTER (WHERE l_linenumber = 4) AS "4" FROM v GROUP BY 1 HAVING count(*) = 4
""")
def in_all_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("string").alias("view"), "l_discount")
    return scoring.in_all_views(lines, "l_suppkey", "view", "l_discount", ["1", "2", "3", "4"])


@query("""
WITH g AS (SELECT n_nationkey, s FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer)), d AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
SELECT n_nationkey, s AS c_mktsegment, n, n IS NULL AS pending FROM g LEFT JOIN d ON c_nationkey = n_nationkey AND c_mktsegment = s
""")
def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by segments with the rich customers counted, combinations without any as pending."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment", "c_acctbal")
    done = customers.filter("c_acctbal > 5000").groupBy("n_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return scoring.task_grid([table(spark, sf_dir, "nation").select("n_nationkey"), customers.select("c_mktsegment").distinct()], done, ["n_nationkey", "c_mktsegment"])


@query("""
WITH m AS (SELECT o_orderpriority AS arm, month(o_orderdate) AS step, round(avg(o_totalprice), 9) AS mean FROM orders GROUP BY 1, 2)
SELECT arm, arg_max(step, (mean, -step))::INT AS step FROM m GROUP BY arm
""")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.month("o_orderdate").alias("step"), "o_totalprice")
    return scoring.best_checkpoint(rows, "arm", "step", "o_totalprice").select("arm", "step")


@query(_GRADED + """
, x AS (SELECT quality, CASE WHEN lang = 'en' THEN ['words', 'english'] WHEN lang = 'de' THEN ['words'] ELSE [] END AS a FROM g)
SELECT c AS class, count(*) AS n, count(quality) AS evaluated FROM (SELECT quality, unnest(CASE WHEN len(a) > 0 THEN a ELSE ['unknown'] END) AS c FROM x) GROUP BY 1
""")
def exploded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several classes for a document, counted in each; none is unknown."""
    classes = F.when(F.col("lang") == "en", F.array(F.lit("words"), F.lit("english"))).when(F.col("lang") == "de", F.array(F.lit("words"))).otherwise(F.array().cast("array<string>"))
    rows = scoring.exploded(_graded(spark, sf_dir).withColumn("a", classes), "a", "class")
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.count("quality").alias("evaluated"))


@query("""
SELECT event_type, count(*) FILTER (WHERE value >= 10) AS n_strict, count(*) FILTER (WHERE value >= 10 AND user_id % 2 = 0) AS n_strict_correct, round(avg((user_id % 2 = 0)::INT) FILTER (WHERE value >= 10), 6) AS strict_accuracy FROM events GROUP BY 1
""")
def format_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = scoring.format_rates(F.col("value") >= 10, F.col("user_id") % 2 == 0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*((r6(c) if k == "strict_accuracy" else c).alias(k) for k, c in rates.items()))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).drop("ts")


@query("""
WITH b AS (SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'error') AS event_id FROM events GROUP BY 1) SELECT user_id, event_id FROM b WHERE event_id IS NOT NULL
""")
def last_matching_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latest(table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("""
WITH e AS (SELECT event_type, ceil((event_id + 1) / 45.0)::BIGINT AS epoch, value FROM events), m AS (SELECT epoch, event_type, avg(value) AS v FROM e GROUP BY 1, 2) SELECT epoch, count(*) AS branches, round(avg(v), 6) AS equal_mean FROM m GROUP BY 1
""")
def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of 45 steps: the mean of the branches' means, each branch alike."""
    rows = table(spark, sf_dir, "events").withColumn("epoch", F.ceil((F.col("event_id") + 1) / 45))
    return rows.groupBy("epoch", "event_type").agg(F.avg("value").alias("v")).groupBy("epoch").agg(F.count("*").alias("branches"), r6(F.avg("v")).alias("equal_mean"))


@query("""
WITH b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island, ts FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY ts, event_id)::INT AS streak FROM b
""")
def state_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many polls in a row have found a user in the same state."""
    user, state = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("island", F.row_number().over(user) - F.row_number().over(state))
    return rows.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id", "event_type", "island").orderBy("ts", "event_id")).alias("streak"))


# -- sets, checks, splits ----------------------------------------------------------------------------------------------

@query("""
WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels), f AS (SELECT a.doc_id AS x, b.doc_id AS y FROM a FULL JOIN b USING (doc_id))
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS "both", count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b, only_a = 0 AS subset, only_a = 0 AND only_b > 0 AS strict, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) = 0 AS disjoint, only_a = 0 AND only_b = 0 AS equal,
  (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT x FROM f WHERE y IS NULL ORDER BY x LIMIT 5)) AS first_only_a, (SELECT coalesce(string_agg(y, ',' ORDER BY y), '') FROM (SELECT y FROM f WHERE x IS NULL ORDER BY y LIMIT 5)) AS first_only_b FROM f
""")
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checks.set_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("first_only_a", "first_only_b")})


@query("""
WITH p AS (SELECT user_id, count(DISTINCT event_type) AS s, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (WHERE s > 1) AS in_several, sum(n - s)::BIGINT AS repeats FROM p
""")
def shards_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as shards of users: how many users are in several."""
    return checks.shard_report(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN a > 1 OR b > 1 THEN 'outside' END, CASE WHEN abs(a + b - 1) > 1e-6 THEN 'sum' END, CASE WHEN a < greatest(a, b) - 1e-6 THEN 'not the greatest' END) AS issues FROM p
""")
def probability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount and tax times ten as a distribution with its first entry as answer."""
    p = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(checks.probability_issues(p, F.lit(0)), ",").alias("issues"))


@query("SELECT p_partkey, abs(p_size * 10.0 - p_retailprice / 40) > greatest(1, 0.02 * p_size * 10.0) AS off FROM part")
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and measured durations derived from a part's size and price."""
    return table(spark, sf_dir, "part").select("p_partkey", checks.timing_issue(F.col("p_size") * 10.0, F.col("p_retailprice") / 40).alias("off"))


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n FROM orders GROUP BY 1)
SELECT o_custkey, s.n::DOUBLE AS stored, n.n::DOUBLE AS recomputed FROM n FULL JOIN s USING (o_custkey) WHERE n.n IS DISTINCT FROM s.n
""")
def summary_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary that misses pending orders, held against the rows."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "P").cast("double").alias("n"))
    return checks.reconciled(stored, orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("n")), ["o_custkey"], "n")


@query("""
WITH h AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY sha256('11:' || o_custkey), o_custkey LIMIT 100) SELECT o_orderkey, o_custkey, o_custkey IN (SELECT o_custkey FROM h) AS held_out FROM orders
""")
def group_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_holdout(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 11, 100)


@query("""
WITH w AS (SELECT c_mktsegment, count(*) AS n, count(*) * 97 / sum(count(*)) OVER () AS exact FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1),
f AS (SELECT *, least(n, greatest(1, floor(exact))) AS q, least(97, sum(n) OVER ()) AS whole FROM w),
t AS (SELECT c_mktsegment, q + CASE WHEN row_number() OVER (ORDER BY exact - q DESC, n DESC, c_mktsegment) <= whole - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM f),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('5:' || c_custkey), c_custkey)::INT AS rank FROM customer)
SELECT c_custkey, c_mktsegment, rank FROM r JOIN t USING (c_mktsegment) WHERE rank <= quota
""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5, 97)


@query()
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select((F.col("o_custkey") % 5).alias("fifth"), "delta_correct")
    out = resample.paired_bootstrap(pairs, ["fifth"], "delta_correct")
    return out.select("fifth", "n", "up", "down", *(r6(c).alias(c) for c in ("mean", "low", "high")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cohort_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(cohort, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low, count(*) AS n FROM orders GROUP BY 1")
def status_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(p == "1-URGENT").alias("urgent"), F.count_if(p == "5-LOW").alias("low"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_partkey LIMIT 48")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 48 largest: the report's own limit."""
    return checks.exactly(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").orderBy(F.desc("p_size"), "p_partkey").limit(48), 48)
