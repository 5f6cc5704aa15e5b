"""Queries over runs and their reviews: options from tokens, views against an anchor, judges, routing, dealing; derived columns are named in docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options, routing
from ..operators import consistency, order, splits
from .screening import r6, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("""
WITH s AS (SELECT vec_id, [ln(exp(embedding[1]::DOUBLE) + exp(embedding[5]::DOUBLE)), ln(exp(embedding[2]::DOUBLE) + exp(embedding[6]::DOUBLE)), ln(exp(embedding[3]::DOUBLE) + exp(embedding[7]::DOUBLE)), embedding[4]::DOUBLE] AS l FROM embeddings),
p AS (SELECT vec_id, unnest(['A', 'B', 'C', 'D']) AS letter, exp(unnest(l)) AS e FROM s), q AS (SELECT vec_id, letter, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p)
SELECT vec_id, arg_min(letter, (-p, letter)) AS best, round(max(p) FILTER (WHERE letter = 'A'), 6) AS p_a, round(ln(max(p) FILTER (WHERE letter = 'A')) - ln(max(p) FILTER (WHERE letter = 'D')), 6) AS gap FROM q GROUP BY 1
""")
def option_probabilities_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters' probabilities from a vector's first numbers as tokens' scores, two tokens for A, B and C."""
    p = options.grouped_probabilities(F.col("embedding"), {"A": [0, 4], "B": [1, 5], "C": [2, 6], "D": [3, 1_000_000]})
    rows = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", options.best_key(F.col("p")).alias("best"), F.round(F.col("p")["A"], 6).alias("p_a"), F.round(options.log_gap(F.col("p")["A"], F.col("p")["D"]), 6).alias("gap"))


_VIEWS = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS v, max(l_partkey) AS part, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT k, v, k % 3 AS g, CASE WHEN q <= 45 THEN chr((65 + part % 4)::INT) END AS p, CASE WHEN k % 7 <> 0 THEN chr((65 + k % 4)::INT) END AS gold FROM l)
"""


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v")).agg(F.max("l_partkey").alias("part"), F.max("l_quantity").alias("q"))
    return lines.select("k", "v", (F.col("k") % 3).alias("g"), F.when(F.col("q") <= 45, F.char(F.col("part") % 4 + 65)).alias("p"), F.when(F.col("k") % 7 != 0, F.char(F.col("k") % 4 + 65)).alias("gold"))


@query(_VIEWS + """
, b AS (SELECT r.*, a.p AS bp, coalesce(r.p = r.gold, false) AS ok, coalesce(a.p = r.gold, false) AS was, r.gold IS NOT NULL AS known FROM r JOIN r a ON r.k = a.k AND a.v = 1)
SELECT g, v, count(*)::BIGINT AS n, count(*) FILTER (WHERE p IS NOT NULL AND known)::BIGINT AS valid, count(*) FILTER (WHERE ok)::BIGINT AS correct, round(count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE p IS NOT NULL AND known), 6) AS accuracy,
  count(*) FILTER (WHERE p IS DISTINCT FROM bp)::BIGINT AS changed, count(*) FILTER (WHERE known AND ok AND NOT was)::BIGINT AS improved, count(*) FILTER (WHERE known AND was AND NOT ok)::BIGINT AS harmed,
  round(count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE p IS NOT NULL AND known) - count(*) FILTER (WHERE was) / count(*) FILTER (WHERE bp IS NOT NULL AND known), 6) AS delta
FROM b GROUP BY 1, 2
""")
def views_against_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as views, the first the anchor; predictions and answers from keys, three categories of orders."""
    out = consistency.against_anchor(_views(spark, sf_dir).withColumn("v", F.col("v").cast("string")), "k", "v", "p", "gold", "1", ["g"])
    return out.withColumns({"v": F.col("v").cast("int"), "accuracy": r6("accuracy"), "delta": r6("delta")})


@query("""
WITH o AS (SELECT o_orderkey, substr(sha256(o_orderkey::VARCHAR), 1, 20) AS item, 'Status of ' || o_orderkey || '?' AS q, o_orderstatus AS r, o_orderpriority AS a FROM orders)
SELECT o_orderkey, 0 AS pass, '{"item":"' || item || '","question":"' || q || '","reference":"' || r || '","candidate":"' || a || '"}' AS source FROM o
UNION ALL SELECT o_orderkey, 1, '{"item":"' || item || '","question":"' || q || '","candidate":"' || a || '","reference":"' || r || '"}' FROM o
""")
def judge_inputs_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two judges are given of each order, with the reference first and last."""
    question = F.concat(F.lit("Status of "), F.col("o_orderkey").cast("string"), F.lit("?"))
    return consistency.judge_inputs(table(spark, sf_dir, "orders"), "o_orderkey", question, F.col("o_orderstatus"), F.col("o_orderpriority"))


@query("""
SELECT o_orderpriority, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_custkey % 5 < 3)::BIGINT AS resolved, count(*) FILTER (WHERE o_custkey % 5 < 3 AND (o_custkey % 5 = 0) = (o_orderstatus = 'F'))::BIGINT AS right,
  round(count(*) FILTER (WHERE o_custkey % 5 < 3 AND (o_custkey % 5 = 0) = (o_orderstatus = 'F')) / count(*), 6) AS accuracy, count(*) FILTER (WHERE o_custkey % 5 = 0 AND o_orderstatus <> 'F')::BIGINT AS false_yes, count(*) FILTER (WHERE o_custkey % 5 IN (1, 2) AND o_orderstatus = 'F')::BIGINT AS false_no FROM orders GROUP BY 1
""")
def judges_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from customers' keys against an order's status, by priority; some stay open."""
    v = F.col("o_custkey") % 5
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("e"), F.when(v < 3, v == 0).alias("v"))
    return consistency.calibration(rows, "o_orderpriority", "e", "v").withColumn("accuracy", r6("accuracy"))


#: Answers without a decision, and their kinds.
UNREAD = [
    ("<answer>A, B</answer>", "conflicting choices"), ("<answer>E.</answer>", "invalid choice"), ("<answer>a dog</answer>", "text without an option"), ("<answer><b> </b></answer>", "empty field"), ("<analysis>x</analysis> <ans", "malformed tag"),
    ("<analysis>so</analysis>no idea", "no field"), ("A/C", "no field"), ("<option>AC", "conflicting choices"),
]


@query(f"SELECT l_returnflag, list_value({', '.join(repr(k) for _, k in UNREAD)})[((l_partkey % {len(UNREAD)}) + 1)::INT] AS kind, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def unread_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of unreadable answers; a line's part picks the answer."""
    text = F.get(F.array(*(F.lit(t) for t, _ in UNREAD)), (F.col("l_partkey") % len(UNREAD)).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", routing.unread_kind(text, F.lit(False)).alias("kind")).groupBy("l_returnflag", "kind").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey % 3 AS a, o_custkey % 2 AS b, o_orderkey % 4 = 0 AS manual FROM orders)
SELECT o_orderkey, concat_ws('|', CASE WHEN manual THEN 'reference by hand' END, CASE WHEN a = 0 AND b = 1 THEN 'reviewers disagree' END, CASE WHEN a = 2 THEN 'judge''s form' END, CASE WHEN b = 0 THEN 'answer is ambiguous' END,
  CASE WHEN NOT manual AND NOT (a = 0 AND b = 1) AND a <> 2 AND b <> 0 THEN 'semantic review' END) AS reasons FROM r
""")
def unresolved_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why orders' reviews are open: verdicts and reasons from customers' keys, every fourth reference by hand."""
    a, b = F.col("o_custkey") % 3, F.col("o_custkey") % 2
    one = F.struct(F.when(a == 0, "YES").when(a == 1, "NO").otherwise("UNCERTAIN").alias("verdict"), F.when(a == 2, "no evidence").otherwise("compared").alias("reason"))
    two = F.struct(F.when(b == 1, "NO").otherwise("UNCERTAIN").alias("verdict"), F.when(b == 0, "It is vague.").otherwise("compared").alias("reason"))
    reasons = routing.unresolved_reasons(F.array(one, two), F.col("o_orderkey") % 4 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(reasons, "|").alias("reasons"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 8)::INT AS shard FROM orders")
def shards_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt round to eight shards, dearest first."""
    placed = order.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])
    return placed.select("o_orderkey", (F.col("position") % 8).cast("int").alias("shard"))


@query("""
WITH s AS (SELECT o_orderkey, sha256('5:' || o_orderkey) AS h FROM orders ORDER BY h, o_orderkey LIMIT 500)
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, row_number() OVER (ORDER BY h, o_orderkey) - 1 AS drawn FROM s
""")
def sample_resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred orders drawn by hash, with their place among them by key and in the order of drawing."""
    key = splits.hash_key(5, F.col("o_orderkey"))
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("h")).orderBy("h", "o_orderkey").limit(500)
    return order.positions(order.positions(drawn, ["h", "o_orderkey"], name="drawn"), ["o_orderkey"], name="place").drop("h")
