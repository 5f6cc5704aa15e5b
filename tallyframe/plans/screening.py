"""Queries over the driver tables: paired screening, metrics, joins, intervals, options, splits.

Each query has the SQL that gives the same rows.  Computed doubles are rounded
to six places in both, as engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import parsers
from ..operators import intervals, joins, metrics, pairing, resample, splits

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a first and a second line as two views of a sample; the customer is the group."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").distinct()
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]

    def view(line: int) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") == line).select("l_orderkey", *order, "l_discount", "l_returnflag")
        one = pairing.keep_first(rows, ["l_orderkey"], [*order, "l_discount", "l_returnflag"])
        return one.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").alias("correct"), F.col("l_discount").alias("p"))

    base = view(1).join(orders, "o_orderkey")
    return pairing.paired(base, view(2), "o_orderkey", "o_custkey")


_VIEWS = """
WITH v AS (
  SELECT l_orderkey AS o_orderkey, l_linenumber AS line, l_returnflag = 'R' AS correct, l_discount AS p FROM lineitem WHERE l_linenumber IN (1, 2)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_returnflag) = 1
), o AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM orders),
d AS (
  SELECT a.o_orderkey, o_custkey, o_orderpriority, a.correct AS base_correct, a.p AS base_p, b.correct AS other_correct, b.p AS other_p,
    b.correct::INT - a.correct::INT AS delta_correct, round(b.p - a.p, 6) AS delta_p
  FROM v a JOIN v b ON a.o_orderkey = b.o_orderkey AND a.line = 1 AND b.line = 2 JOIN o ON o.o_orderkey = a.o_orderkey
), pairs AS (
  SELECT *, CASE WHEN delta_correct = 1 THEN 'A' WHEN delta_correct = 0 AND delta_p >= 0.10 THEN 'B' WHEN delta_correct = -1 THEN 'C' ELSE 'D' END AS tier FROM d
)
"""


@query(_VIEWS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY delta_correct DESC, delta_p DESC, other_p DESC, o_orderkey) AS group_rank FROM pairs)
SELECT o_orderkey, o_custkey, tier, delta_correct, delta_p, group_rank::INT AS group_rank FROM r WHERE group_rank <= 2
ORDER BY delta_correct DESC, delta_p DESC, other_p DESC, o_orderkey LIMIT 500
""")
def gap_select_topn_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("delta_correct"), F.desc("delta_p"), F.desc("other_p"), F.col("o_orderkey")]
    return pairing.capped_top(_pairs(spark, sf_dir), "o_custkey", order, 2, 500).select("o_orderkey", "o_custkey", "tier", "delta_correct", "delta_p", "group_rank")


@query(_VIEWS + """
SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_groups, round(avg(base_correct::INT), 6) AS base_accuracy, round(avg(other_correct::INT), 6) AS other_accuracy,
  round(avg(delta_p), 6) AS mean_delta_p, round(median(delta_p), 6) AS median_delta_p, count(*) FILTER (WHERE delta_p > 0) AS n_gain, count(*) FILTER (WHERE delta_p >= 0.1) AS n_gain_10
FROM pairs
""")
def gap_overall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_groups"), r6(F.avg(F.col("base_correct").cast("int"))).alias("base_accuracy"),
        r6(F.avg(F.col("other_correct").cast("int"))).alias("other_accuracy"), r6(F.avg("delta_p")).alias("mean_delta_p"), r6(F.median("delta_p")).alias("median_delta_p"),
        F.count_if(F.col("delta_p") > 0).alias("n_gain"), F.count_if(F.col("delta_p") >= 0.1).alias("n_gain_10"),
    )


@query(_VIEWS + "SELECT tier, count(*) AS n, round(avg(delta_p), 6) AS mean_delta_p FROM pairs GROUP BY tier")
def gap_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), r6(F.avg("delta_p")).alias("mean_delta_p"))


@query(_VIEWS + "SELECT base_correct, other_correct, count(*) AS n FROM pairs GROUP BY ALL")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.transitions(_pairs(spark, sf_dir))


@query(_VIEWS + """
, m AS (SELECT count(*) FILTER (WHERE delta_correct = 1) AS b, count(*) FILTER (WHERE delta_correct = -1) AS c FROM pairs),
t AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS k FROM m)
SELECT b, c, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))), 6) AS p_value FROM t GROUP BY b, c
""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _pairs(spark, sf_dir).agg(F.count_if(F.col("delta_correct") == 1).alias("b"), F.count_if(F.col("delta_correct") == -1).alias("c"))
    return n.select("b", "c", r6(metrics.mcnemar(F.col("b"), F.col("c"))).alias("p_value"))


@query("""
WITH g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS s FROM orders GROUP BY 1), z AS (SELECT 1.959963984540054 AS z)
SELECT o_orderpriority, n, s, round(greatest(0, (s / n + z * z / (2 * n) - z * sqrt(s / n * (1 - s / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low,
  round(least(1, (s / n + z * z / (2 * n) + z * sqrt(s / n * (1 - s / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM g, z
""")
def wilson_ci_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"))
    low, high = metrics.wilson(F.col("s"), F.col("n"))
    return g.select("o_orderpriority", "n", "s", r6(low).alias("low"), r6(high).alias("high"))


@query("""
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS low,
  round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS high FROM orders GROUP BY 1
""")
def mean_ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, low, high = metrics.mean_ci(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(mean, 4).alias("mean"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    length = fx.bucket(F.col("n_chars"), [500, 2000, 8000], ["short", "medium", "long", "huge"])
    return docs.join(labels, "doc_id", "left").withColumns({"correct": F.col("quality") == 1, "length": length})


_GRADED = """
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
g AS (
  SELECT d.doc_id, lang, source, n_chars, quality, toxic, quality = 1 AS correct,
    CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 8000 THEN 'long' WHEN n_chars IS NOT NULL THEN 'huge' END AS length
  FROM documents d LEFT JOIN l USING (doc_id)
)
"""
_TRI = """count(*) AS n, count(*) FILTER (WHERE correct) AS n_true, count(*) FILTER (WHERE NOT correct) AS n_false, count(*) FILTER (WHERE correct IS NULL) AS n_undecided,
  round(CASE WHEN count(*) FILTER (WHERE correct IS NULL) = 0 THEN count(*) FILTER (WHERE correct) / count(*) END, 6) AS accuracy,
  round(count(*) FILTER (WHERE correct) / count(*), 6) AS lower, round(count(*) FILTER (WHERE correct IS DISTINCT FROM false) / count(*), 6) AS upper"""


def _tri() -> dict:
    return {k: r6(c) if k in ("accuracy", "lower", "upper") else c for k, c in metrics.tri_state(F.col("correct")).items()}


@query(_GRADED + f"SELECT lang, {_TRI} FROM g GROUP BY lang")
def tri_state_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).groupBy("lang").agg(*metrics.aliased(_tri()))


@query(_GRADED + f"""
SELECT 'overall' AS dimension, 'all' AS value, {_TRI} FROM g UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), {_TRI} FROM g GROUP BY lang
UNION ALL SELECT 'source', coalesce(source, 'unknown'), {_TRI} FROM g GROUP BY source UNION ALL SELECT 'length', coalesce(length, 'unknown'), {_TRI} FROM g GROUP BY length
""")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped(_graded(spark, sf_dir), ["lang", "source", "length"], _tri())


@query(_GRADED + """
SELECT lang, count(*) AS n, sum(coalesce(toxic, 0) - coalesce(quality, 1)) AS lower_sum, sum(coalesce(toxic, 1) - coalesce(quality, 0)) AS upper_sum,
  count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS known_up, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS known_down FROM g GROUP BY lang
""")
def paired_unknown_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return _graded(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(t, F.lit(0)) - F.coalesce(q, F.lit(1))).alias("lower_sum"), F.sum(F.coalesce(t, F.lit(1)) - F.coalesce(q, F.lit(0))).alias("upper_sum"),
        F.count_if((q == 0) & (t == 1)).alias("known_up"), F.count_if((q == 1) & (t == 0)).alias("known_down"),
    )


@query("SELECT coalesce(json_extract_string(props, '$.k')::INT % 10, -1)::INT AS answer, count(*) AS n FROM events GROUP BY 1")
def value_counts_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.get_json_object("props", "$.k").try_cast("int") % 10
    return table(spark, sf_dir, "events").groupBy(F.coalesce(parsed, F.lit(-1)).alias("answer")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, max(n_chars) FILTER (WHERE i = 1 + ((n - 1) * 9 + 5) // 10) AS p90, min(n_chars) AS least, max(n_chars) AS most FROM r GROUP BY lang
""")
def dist_summary_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nearest rank from counts of distinct values: a group's rows are added up, never gathered.
    docs = table(spark, sf_dir, "documents").filter("n_chars IS NOT NULL")
    values = docs.groupBy("lang", "n_chars").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("lang").orderBy("n_chars"))
    whole = docs.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg("n_chars")).alias("mean"), F.median("n_chars").alias("median"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    at = F.floor(((F.col("n") - 1) * 9 + 5) / 10) + 1
    p90 = values.withColumn("upto", upto).join(F.broadcast(whole.select("lang", "n")), "lang").filter(F.col("upto") >= at).groupBy("lang").agg(F.min("n_chars").alias("p90"))
    return whole.join(p90, "lang").select("lang", "n", "mean", "median", "p90", "least", "most")


@query("""
WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT count(*) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL) AS matched, count(*) FILTER (WHERE b.n IS NULL) AS missing, count(*) FILTER (WHERE a.n IS NULL) AS extra,
  count(*) FILTER (WHERE a.n > 1 OR b.n > 1) AS repeated FROM a FULL JOIN b USING (doc_id)
""")
def strict_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH s AS (SELECT conv_id, sha256(coalesce(string_agg(role || '|' || text, chr(10) ORDER BY turn, role, text) FILTER (WHERE role <> 'assistant'), '')) AS signature, count(*) AS n_turns FROM conversations GROUP BY 1)
SELECT signature, count(*) AS n, min(conv_id) AS first_conv, sum(n_turns)::BIGINT AS n_turns FROM s GROUP BY 1
""")
def signature_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("m"), F.count("*").alias("n_turns"))
    return turns.withColumn("signature", joins.signature(F.col("m"))).groupBy("signature").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"), F.sum("n_turns").alias("n_turns"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def group_disjoint_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return joins.without_groups(orders, orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""
WITH v AS (SELECT doc_id, max(quality) AS a, max(toxic) AS b FROM labels GROUP BY 1)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE a = 0 AND b = 1) AS recovered, count(*) FILTER (WHERE a = 1 AND b = 0) AS revoked, count(*) FILTER (WHERE a = b) AS same
FROM v JOIN documents USING (doc_id) GROUP BY lang
""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("a"), F.max("toxic").alias("b"))
    old = labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("a").alias("v"))
    return joins.changes(old, labels.select("doc_id", F.col("b").alias("v")), "doc_id", "v", ["lang"])


@query(_GRADED + "SELECT doc_id, coalesce(quality::BIGINT, n_chars) AS n_chars, quality IS NOT NULL AS patched FROM g")
def overlay_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("n_chars"))
    return joins.overlay(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), patch, "doc_id", "n_chars")


def _spans(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events as spans of seconds since 2024, by user and day."""
    e = table(spark, sf_dir, "events")
    e = e if kind is None else e.filter(F.col("event_type") == kind)
    second = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").cast("double") - F.lit(1704067200.0)
    return e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), second.alias("s"), (second + F.floor(F.col("value")) + 1).alias("e"))


_SPANS = """
WITH spans AS (
  SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, floor(epoch(ts)) - 1704067200 AS s, floor(epoch(ts)) - 1704067200 + floor(value) + 1 AS e FROM events
)
"""
_UNION = """
, {name}_r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM {name}_r),
{name} AS (SELECT user_id, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY user_id, island)
"""


@query(_SPANS + _UNION.format(name="u", source="spans") + "SELECT user_id, s, e FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(_spans(spark, sf_dir), ["user_id"])


@query(_SPANS + ", w AS (SELECT user_id, greatest(s - 60, 0) AS s, least(e + 60, 2592000) AS e FROM spans)" + _UNION.format(name="u", source="w") + "SELECT user_id, s, e FROM u")
def interval_halo_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(_spans(spark, sf_dir), ["user_id"], halo=60.0, low=F.lit(0.0), high=F.lit(2592000.0))


@query(_SPANS + _UNION.format(name="u", source="spans") + "SELECT user_id, e AS s, n AS e FROM (SELECT user_id, e, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM u) WHERE n IS NOT NULL")
def interval_complement_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(intervals.union(_spans(spark, sf_dir), ["user_id"]), ["user_id"])


@query(_SPANS + """
SELECT a.user_id, a.day, round(max(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s))), 6) AS best_iou
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1, 2
""")
def interval_iou_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = intervals.best_overlap(_spans(spark, sf_dir, "click"), _spans(spark, sf_dir, "view"), ["user_id", "day"])
    return best.select("user_id", "day", r6("best_iou").alias("best_iou"))


@query(_SPANS + "SELECT p.user_id, p.s AS at FROM spans p WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM spans q WHERE q.user_id = p.user_id AND q.event_type = 'purchase' AND p.s BETWEEN q.s AND q.e)")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _spans(spark, sf_dir, "error").select("user_id", F.col("s").alias("at"))
    return intervals.points_inside(points, _spans(spark, sf_dir, "purchase"), ["user_id"], "at")


@query("""
WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT *, n * 1000.0::DOUBLE / sum(n) OVER () AS exact FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, c_nationkey) AS k, 1000 - sum(floor(exact)) OVER () AS left_over FROM x)
SELECT c_nationkey, n, (floor(exact) + CASE WHEN k <= left_over THEN 1 ELSE 0 END)::BIGINT AS share FROM r
""")
def largest_remainder_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return intervals.largest_remainder(n, ["c_nationkey"], "n", 1000)


_SOFT = """
WITH x AS (SELECT vec_id, label, embedding[1:4]::DOUBLE[] AS v FROM embeddings), e AS (SELECT vec_id, label, list_transform(v, lambda z: exp(z - list_max(v))) AS e FROM x),
p AS (SELECT vec_id, label, list_transform(e, lambda z: z / list_sum(e)) AS p FROM e)
"""


@query(_SOFT + "SELECT vec_id, round(-list_sum(list_transform(p, lambda z: z * ln(z))) / ln(4), 6) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(list_max(p), 6) AS confidence FROM p")
def option_softmax_entropy_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    p = table(spark, sf_dir, "embeddings").select("vec_id", fx.softmax(scores).alias("p"))
    return p.select("vec_id", r6(fx.entropy(F.col("p"))).alias("entropy"), r6(fx.margin(F.col("p"))).alias("margin"), r6(F.array_max("p")).alias("confidence"))


@query(_SOFT + """
, o AS (SELECT label, unnest(p) AS q, unnest(['A', 'B', 'C', 'D']) AS letter, list_max(p) AS w FROM p), s AS (SELECT label, letter, sum(q * w) / sum(w) AS share FROM o GROUP BY 1, 2)
SELECT label, letter, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(share, 9) DESC, letter) = 1
""")
def consensus_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    p = table(spark, sf_dir, "embeddings").select("label", fx.softmax(scores).alias("p")).select("label", "p", F.array_max("p").alias("w"))
    options = p.select("label", "w", F.posexplode("p").alias("i", "q"))
    share = options.groupBy("label", "i").agg((F.sum(F.col("q") * F.col("w")) / F.sum("w")).alias("share"))
    best = share.groupBy("label").agg(F.max_by(F.struct("i", "share"), F.struct(F.round("share", 9), -F.col("i"))).alias("b"))
    return best.select("label", F.element_at(F.split(F.lit("A,B,C,D"), ","), F.col("b.i") + 1).alias("letter"), r6("b.share").alias("share"))


_LINES = "SELECT l_orderkey, l_linenumber, l_returnflag, max(l_discount) AS p FROM lineitem GROUP BY ALL"


@query("""
WITH n AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, sum(n) AS valid, max(n) AS most, arg_max(v, n * 1000 + ascii(v)) AS top FROM n GROUP BY 1)
SELECT o_orderkey, CASE WHEN most * 2 > valid THEN top ELSE o_orderstatus END AS choice, coalesce(most * 2 > valid, false) AS by_majority
FROM (SELECT o_orderkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1) o LEFT JOIN t ON o_orderkey = l_orderkey
""")
def strict_majority_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("vote"))
    anchor = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_orderstatus").alias("anchor"))
    return pairing.majority(votes, "o_orderkey", "vote", anchor)


@query("""
WITH v AS (SELECT l_orderkey, l_linestatus || l_returnflag AS view, max(l_discount) AS p FROM lineitem GROUP BY ALL)
SELECT l_orderkey, view, p FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, list_position(['FA', 'FN', 'FR', 'OA', 'ON', 'OR'], view)) = 1
""")
def oracle_view_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_linestatus", "l_returnflag").alias("view")).agg(F.max("l_discount").alias("p"))
    return pairing.best_view(views, "l_orderkey", "view", "p", ["FA", "FN", "FR", "OA", "ON", "OR"])


@query("""
WITH w AS (SELECT l_suppkey, avg(l_discount) FILTER (WHERE l_linenumber = 1) AS a0, avg(l_discount) FILTER (WHERE l_linenumber = 2) AS a1, avg(l_discount) FILTER (WHERE l_linenumber = 3) AS a2, avg(l_discount) FILTER (WHERE l_linenumber = 4) AS a3 FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(avg(a3 - a2 - a1 + a0), 6) AS interaction FROM w WHERE a0 IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL
""")
def interaction_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("string").alias("arm"), "l_discount")
    return metrics.contrast(lines, "l_suppkey", "arm", "l_discount", ["1", "2", "3", "4"]).select("n", r6("interaction").alias("interaction"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey)::INT AS rank FROM customer QUALIFY rank <= 20")
def per_task_hash_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_cap(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 7, 20)


@query("""
WITH h AS (SELECT p_partkey, ('0x' || substr(sha256('7:' || p_partkey), 1, 8))::BIGINT / 4294967296 AS u FROM part)
SELECT p_partkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM h
""")
def hash_rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7, {"train": 0.8, "dev": 0.1, "test": 0.1})


@query("SELECT s_suppkey, s_nationkey, ((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 4)::INT AS shard FROM supplier")
def strided_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.strided_shards(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey", 4)


@query("""
SELECT md5(trim(lower(text))) AS k, count(*) AS n, count(DISTINCT source) AS payloads, count(DISTINCT source) > 1 AS conflict FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def dedup_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5(F.trim(F.lower("text"))).alias("k"), "source")
    return splits.duplicates(keyed, ["k"], "source")


@query("SELECT md5(trim(lower(text))) AS k, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_keep_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5(F.trim(F.lower("text"))).alias("k"), "doc_id", "source")
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN length(trim(text)) < 20 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN lang <> 'en' THEN 'foreign' END) AS issues FROM documents
""")
def issues_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"short": F.length(F.trim("text")) < 20, "long": F.col("n_chars") > 20000, "table": F.contains("text", F.lit("|")), "foreign": F.col("lang") != "en"}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fx.issues(rules), ",").alias("issues"))


@query(_GRADED + "SELECT length, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM g GROUP BY 1")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).groupBy("length").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT item_id, CASE WHEN contains(lower(text), 'tion') AND contains(lower(text), 'the ') THEN 'prose' WHEN contains(lower(text), 'tion') THEN 'dense' WHEN contains(lower(text), 'que') THEN 'romance' ELSE 'other' END AS category FROM benchmark
""")
def taxonomy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    prose = F.when(F.contains(text, F.lit("tion")) & F.contains(text, F.lit("the ")), "prose")
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(prose, fx.first_rule(text, {"dense": ["tion"], "romance": ["que"]}, "other")).alias("category"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9_]+)') AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' ')) AS r FROM w WHERE len(w) >= 20)
SELECT doc_id, round(1 - len(list_distinct(r)) / len(r), 6) AS repeated FROM g
""")
def ngram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(fx.repeated_ngrams(F.col("text"))).alias("repeated")).filter("repeated IS NOT NULL")


@query("""
SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events
""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", r6(F.avg("value").over(w)).alias("mean"))


@query("""
SELECT o_orderstatus, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 4) AS high,
  round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 4) AS low FROM orders GROUP BY 1
""")
def pivot_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.round(F.avg("o_totalprice"), 4))
    return wide.toDF("o_orderstatus", "urgent", "high", "low")


@query("""
SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_correct, count(*) FILTER (WHERE l_returnflag = 'R') AS n_correct,
  arg_max(l_partkey, (l_discount, l_tax, -l_partkey)) AS best FROM lineitem GROUP BY 1
""")
def best_interval_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(right).alias("any_correct"), F.count_if(right).alias("n_correct"), F.max_by("l_partkey", F.struct("l_discount", "l_tax", -F.col("l_partkey"))).alias("best"))


@query("""
WITH p AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause FROM events),
s AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM p)
SELECT user_id, session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir).select("lang", "source", "quality")
    out = resample.cluster_bootstrap(graded, ["lang"], "source", "quality")
    return out.select("lang", "n", *(r6(c).alias(c) for c in ("mean", "low", "high")))


@query("SELECT p_partkey, p_brand FROM part QUALIFY (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 16 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.systematic(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 16).drop("place")


@query(r"""
WITH t AS (SELECT conv_id, turn, upper(text) AS t FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(t, '<ANSWER>\s*([A-Z])\s*[.)]?\s*</ANSWER>', 1), ''), nullif(regexp_extract(t, '(?:FINAL ANSWER|ANSWER|OPTION|CHOICE)\s*(?:IS|:)?\s*\(?([A-Z])(?:[).:,\s]|$)', 1), ''),
  nullif(regexp_extract(t, '^\s*\(?([A-Z])[).:]?\s*$', 1), '')) AS letter FROM t
""")
def mcq_letter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsers.answer_letter(F.col("text")).alias("letter"))
