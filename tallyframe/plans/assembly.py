"""Queries over the driver tables that put sets of samples together; where a column is derived, the docstring says how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly
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
SELECT o_orderkey AS k, arm, CASE arm WHEN 'text' THEN NULL ELSE o_totalprice END AS price, CASE arm WHEN 'clue' THEN o_orderpriority END AS clue, o_orderstatus AS status
FROM orders CROSS JOIN (VALUES ('text'), ('full'), ('clue')) AS a(arm)
""")
def arms_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arms of every order: without its price, with it, and with its priority as a clue."""
    price = F.col("o_totalprice")
    specs = {"text": {}, "full": {"price": price}, "clue": {"price": price, "clue": F.col("o_orderpriority")}}
    return assembly.arms(table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "k", "o_orderstatus": "status"}), ["k", "status"], specs)


@query("SELECT l_orderkey AS k, count(DISTINCT l_linenumber)::BIGINT AS n_arms, count(DISTINCT l_returnflag || l_linestatus)::BIGINT AS n_inputs FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) <> 2 OR count(DISTINCT l_returnflag || l_linestatus) <> 1")
def arms_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which the first two lines, as arms, are not both there or differ in flag or status."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("arm"), "l_returnflag", "l_linestatus")
    return assembly.unlike_arms(lines, ["k"], ["l_returnflag", "l_linestatus"], 2)


@query("""
SELECT coalesce(CASE WHEN p_size % 3 > 0 THEN 'new/' || p_brand END, p_brand) AS path, p_size % 3 = 0 AS missing, count(*)::BIGINT AS n
FROM (SELECT p_brand || '-' || (p_size % 3) AS p_brand, p_size FROM part) GROUP BY ALL
""")
def paths_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of a part's brand and size modulo 3, moved by a map that lacks those of 0."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", (F.col("p_size") % 3).cast("string")).alias("path"))
    known = parts.distinct().filter(~F.col("path").endswith("-0")).select(F.col("path").alias("old"), F.concat(F.lit("new/"), "path").alias("new"))
    return assembly.rewritten(parts, "path", known).groupBy("path", "missing").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT user_id AS k, list(value ORDER BY event_id) FILTER (WHERE event_type = 'purchase') AS a, list(value ORDER BY event_id) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY user_id)
SELECT k, CASE WHEN len(a) > 0 THEN 'purchase' WHEN len(b) > 0 THEN 'click' END AS used, len(coalesce(a, b))::INT AS n, round(coalesce(a, b)[1], 6) AS first_value FROM s
""")
def evidence_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's purchases, or without any, clicks, as evidence; few of these for a user, in order of their ids."""
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "value")))), lambda x: x["value"])
    sets = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(pick("purchase").alias("a"), pick("click").alias("b"))
    used = assembly.first_list(F.col("a"), F.col("b"))
    return sets.select("k", F.when(F.size("a") > 0, "purchase").when(F.size("b") > 0, "click").alias("used"), F.when(used.isNotNull(), F.size(used)).alias("n"), r6(F.get(used, F.lit(0))).alias("first_value"))


@query("""
WITH u AS (SELECT l_orderkey AS k, 0 AS source, l_linenumber AS o, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 1, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'R')
SELECT k, source, o, q FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY source, o, q) = 1
""")
def sources_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first returned line, without one its first line of the others."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("o"), F.col("l_quantity").alias("q")).alias("line"), "l_returnflag")
    sources = [lines.filter(c).drop("l_returnflag") for c in ("l_returnflag = 'R'", "l_returnflag <> 'R'")]
    return assembly.by_precedence(sources, ["k"], "line").select("k", "source", "line.*")


@query("""
WITH m AS (SELECT o_orderpriority AS p, o_orderstatus AS s, avg(o_totalprice) AS price FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority AS p, o_orderstatus AS s, avg(o_totalprice) AS price FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL)
SELECT p, s, round(m.price, 4) AS price, round(b.price, 4) AS before, round(m.price - b.price, 4) AS change FROM m JOIN b USING (p, s)
""")
def delta_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices by priority and status against the same of the orders before 1996."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "p", "o_orderstatus": "s"})
    mean = lambda rows: rows.groupBy("p", "s").agg(F.avg("o_totalprice").alias("price"))
    out = assembly.delta(mean(orders), mean(orders.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))), ["p", "s"], "price")
    return out.select("p", "s", *(F.round(c, 4).alias(c) for c in ("price", "before", "change")))


@query("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders minus the finished ones, which are a true part of them."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "k", "o_custkey": "c"})
    return assembly.difference(orders.select("k", "c"), orders.filter("o_orderstatus = 'F'").select("k"), "k")


@query("""
WITH d AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 END) AS verdict, max(toxic) AS t FROM labels GROUP BY doc_id), r AS (SELECT doc_id, verdict, t, CASE WHEN t = 1 THEN 'toxic' WHEN doc_id % 2 = 0 THEN ' ' ELSE 'read' END AS reason, CASE WHEN doc_id % 5 > 0 THEN 'r' END AS reviewer FROM d),
a AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN verdict IS NOT NULL THEN 'already decided' WHEN trim(reason) = '' THEN 'no reason' WHEN reviewer IS NULL THEN 'no reviewer' ELSE 'filled' END END AS adjudication FROM r)
SELECT adjudication, CASE WHEN adjudication = 'filled' THEN 0 ELSE verdict END AS verdict, count(*)::BIGINT AS n FROM a GROUP BY ALL
""")
def nulls_adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not of quality 1 are undecided; decisions made from the id and label fill some of them."""
    d = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1)).alias("verdict"), F.max("toxic").alias("t"))
    reason = F.when(F.col("t") == 1, "toxic").when(F.col("doc_id") % 2 == 0, " ").otherwise("read")
    decisions = d.filter("doc_id % 3 > 0").select("doc_id", F.lit(0).alias("verdict"), reason.alias("reason"), F.when(F.col("doc_id") % 5 > 0, "r").alias("reviewer"))
    return assembly.filled(d.select("doc_id", "verdict"), decisions, ["doc_id"], "verdict").groupBy("adjudication", "verdict").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, l_suppkey AS unit FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.0)")
def quarantine_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without those of suppliers that have sold fifty without discount."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("unit"), "l_quantity", "l_discount")
    return assembly.expanded_out(lines.select("k", "line", "unit"), lines.filter("l_quantity = 50 AND l_discount = 0"), "unit").select("k", "line", "unit")


@query("""
WITH v AS (SELECT l_orderkey, max((l_returnflag = 'N')::INT) FILTER (WHERE l_linenumber = 1) AS a, max((l_returnflag = 'N')::INT) FILTER (WHERE l_linenumber = 2) AS b FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN a = 1 AND b = 1 THEN 'both' WHEN a = 1 AND b = 0 THEN 'first_only' WHEN a = 0 AND b = 1 THEN 'second_only' WHEN a = 0 AND b = 0 THEN 'both_wrong' END AS views, count(*)::BIGINT AS n FROM v GROUP BY ALL
""")
def views_complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 1 and 2 of an order as views, right where not returned."""
    right = lambda line: F.max(F.when(F.col("l_linenumber") == line, F.col("l_returnflag") == "N"))
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(right(1).alias("a"), right(2).alias("b"))
    return v.groupBy(assembly.complementarity(F.col("a"), F.col("b"), ("first", "second")).alias("views")).agg(F.count("*").alias("n"))


@query("""
SELECT l_linestatus AS g, count(*)::BIGINT AS total, count(nullif(l_returnflag, 'A'))::BIGINT AS parsed, count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS failures, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS correct,
round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE, 6) AS accuracy, round(count(nullif(l_returnflag, 'A')) / count(*)::DOUBLE, 6) AS parse_rate, min(l_discount) AS ratio_min, round(avg(l_discount), 6) AS ratio_mean, max(l_discount) AS ratio_max FROM lineitem GROUP BY l_linestatus
""")
def answers_summed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as predictions (A is none, R right) by line status, with the discount as the ratio."""
    p = F.nullif(F.col("l_returnflag"), F.lit("A"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), p.alias("p"), (p == "R").alias("ok"), F.col("l_discount").alias("ratio"))
    out = assembly.answer_summary(rows, ["g"], "p", "ok", "ratio")
    return out.withColumns({c: r6(c) for c in ("accuracy", "parse_rate", "ratio_mean")})


@query("""
WITH d AS (SELECT lang, quality, n_chars // 1000 AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))
SELECT lang, count(*) FILTER (WHERE coalesce(quality = 1, false))::BIGINT AS sufficient, count(*) FILTER (WHERE NOT coalesce(quality = 1, false) AND coalesce(n, 0) > 0)::BIGINT AS insufficient, count(*) FILTER (WHERE NOT coalesce(quality = 1, false) AND coalesce(n, 0) <= 0)::BIGINT AS skipped,
round(sufficient / nullif(sufficient + insufficient, 0)::DOUBLE, 6) AS rate FROM d GROUP BY lang
""")
def sufficiency_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language: sufficient at quality 1, else insufficient from 1000 characters on, else skipped."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return assembly.sufficiency(d, ["lang"], F.floor(F.col("n_chars") / 1000), F.col("quality") == 1).withColumn("rate", r6("rate"))


@query("SELECT user_id AS k, count(*)::BIGINT AS beats, max(ts) AS last_at, round(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(max(ts)) / 1e6, 3) AS age, epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(max(ts)) / 1e6 > 86400 AS stale FROM events GROUP BY user_id")
def workers_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as beats, looked at on 1 February 2024; stale after a day."""
    out = assembly.liveness(table(spark, sf_dir, "events").withColumnRenamed("user_id", "k"), ["k"], "ts", F.lit("2024-02-01").cast("timestamp"), 86400.0)
    return out.withColumn("age", F.round("age", 3))


@query("SELECT p_brand AS name, regexp_extract(p_brand, '(\\d+)\\D*$', 1)::BIGINT AS number, count(*)::BIGINT AS n FROM part WHERE p_size <= 30 GROUP BY ALL")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with the number that orders them, counted over sizes up to a cap of 30."""
    parts = table(spark, sf_dir, "part").filter(assembly.within_cap(F.col("p_size"), 30))
    return parts.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).select("name", assembly.numeric_part(F.col("name")).alias("number"), "n").orderBy("number", "name")
