"""Queries over spans that are submitted with faults, and overlaps and rules over many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budgets, compare, farthest, order, repairs
from .screening import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Line k of an order submits a span from 30 k - 40 on; with only one line it is long.
_SUBMITTED = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, 30.0 * i - 40 AS s0, 30.0 * i - 40 + CASE WHEN count(*) OVER (PARTITION BY k) = 1 THEN 3 * q ELSE 0.7 * q END AS e0 FROM l),
f AS (SELECT *, greatest(0, least(165, s0)) AS lo, greatest(0, least(165, e0)) AS hi FROM c),
x AS (SELECT *, greatest(0, least(165, greatest(0, lo - (1 - (hi - lo)) / 2) + 1) - 1) AS s1, least(165, greatest(0, lo - (1 - (hi - lo)) / 2) + 1) AS e1 FROM f WHERE hi > lo),
g AS (SELECT k, i, n, CASE WHEN hi - lo < 1 - 1e-6 THEN s1 ELSE lo END AS s, CASE WHEN hi - lo < 1 - 1e-6 THEN e1 ELSE hi END AS e FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) <= 4),
p AS (SELECT *, CASE WHEN n = 1 AND e - s > 40 + 1e-6 THEN greatest(2, least(4, ceil((e - s) / 40)))::INT END AS pieces FROM g),
d AS (
  SELECT k, i, 0 AS j, s, e FROM p WHERE pieces IS NULL
  UNION ALL SELECT k, i, j, s + (e - s - 40.0 / pieces) * j / (pieces - 1) AS s, s + (e - s - 40.0 / pieces) * j / (pieces - 1) + 40.0 / pieces AS e FROM p, unnest(range(0, 4)) AS r(j) WHERE j < pieces
), t AS (
  SELECT *, sum(e - s) OVER (PARTITION BY k) AS total, coalesce(sum(e - s) OVER (PARTITION BY k ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(e - s) OVER (PARTITION BY k ORDER BY i, j) AS upto FROM d
), u AS (
  SELECT k, i, j, s, CASE WHEN total <= 40 + 1e-6 OR upto <= 40 + 1e-6 THEN e WHEN before < 40 AND 40 - before >= 1 - 1e-6 THEN s + 40 - before END AS e FROM t
), r AS (SELECT k, ceil((s - 1e-9) * 1000) / 1000 AS s, floor((e + 1e-9) * 1000) / 1000 AS e FROM u WHERE e IS NOT NULL)
"""


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("q"))
    held = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("lines"))  # an order has few lines
    many = F.when(F.size("lines") == 1, 3.0).otherwise(0.7)
    spans = F.transform("lines", lambda x: F.struct((30.0 * x.i - 40).alias("s"), (30.0 * x.i - 40 + many * x.q).alias("e"), F.concat(F.lit("line "), x.i.cast("string")).alias("note")))
    return held.select("k", repairs.repaired(spans, F.lit(165.0), F.lit(40.0)).alias("r"))


@query(_SUBMITTED + "SELECT k, count(*)::BIGINT AS n, round(sum(e - s), 3) AS seconds, min(s) AS first_s, max(e) AS last_e FROM r GROUP BY k")
def spans_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's submitted spans, repaired: clamped, grown, counted, split, trimmed and rounded."""
    rows = _submitted(spark, sf_dir).select("k", F.explode("r.spans").alias("x"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x.e") - F.col("x.s")), 3).alias("seconds"), F.min("x.s").alias("first_s"), F.max("x.e").alias("last_e"))


@query(_SUBMITTED + """
, k AS (
  SELECT 'dropped empty' AS kind, count(*) AS n FROM f WHERE hi <= lo
  UNION ALL SELECT 'expanded short', count(*) FROM f WHERE hi > lo AND hi - lo < 1 - 1e-6
  UNION ALL SELECT 'clamped', count(*) FROM x WHERE abs(CASE WHEN hi - lo < 1 - 1e-6 THEN s1 ELSE lo END - s0) > 1e-9 OR abs(CASE WHEN hi - lo < 1 - 1e-6 THEN e1 ELSE hi END - e0) > 1e-9
  UNION ALL SELECT 'dropped extra', count(*) FROM (SELECT k FROM x GROUP BY k HAVING count(*) > 4)
  UNION ALL SELECT 'split to cover', count(*) FROM p WHERE pieces IS NOT NULL
  UNION ALL SELECT 'trimmed', count(*) FROM t WHERE total > 40 + 1e-6 AND upto > 40 + 1e-6 AND before < 40 AND 40 - before >= 1 - 1e-6
  UNION ALL SELECT 'enforced budget', count(DISTINCT k) FROM t WHERE total > 40 + 1e-6
) SELECT kind, n::BIGINT AS n FROM k WHERE n > 0
""")
def span_repairs_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each repair was made."""
    return _submitted(spark, sf_dir).select(F.explode("r.log").alias("x")).groupBy(F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"))


# -- many arms with common draws: an order line's number is the arm, its supplier the cluster ------------------------------

_ARMS = ["1", "2", "3", "4"]
_CONTRASTS = {"interaction": {"4": 1, "3": -1, "2": -1, "1": 1}, "2 over 1": {"2": 1, "1": -1}, "3 over 1": {"3": 1, "1": -1}, "4 over 1": {"4": 1, "1": -1}, "4 over 2": {"4": 1, "2": -1}, "3 over 2": {"3": 1, "2": -1}}


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_linenumber").cast("string").alias("arm"), (F.col("l_discount") > 0.05).cast("int").alias("right"))
    return compare.compared(lines, "l_suppkey", "arm", "right", _ARMS, _CONTRASTS, ["l_returnflag"])


def _weighted(w: dict[str, float]) -> tuple[str, str]:
    return " + ".join(f"{k} * m[{a}]" for a, k in w.items()), " + ".join(f"n[{a}]" for a in w)


@query("""
WITH l AS (SELECT l_returnflag AS f, l_linenumber AS a, (l_discount > 0.05)::INT AS r FROM lineitem WHERE l_linenumber <= 4),
m AS (SELECT 'overall' AS dimension, 'all' AS g, a, avg(r) AS m, count(r) AS n FROM l GROUP BY a UNION ALL SELECT 'l_returnflag', f, a, avg(r), count(r) FROM l GROUP BY f, a),
w AS (SELECT dimension, g, list(m ORDER BY a) AS m, list(n ORDER BY a) AS n FROM m GROUP BY 1, 2)
""" + " UNION ALL ".join(f"SELECT dimension, g AS \"group\", '{name}' AS name, ({n})::BIGINT AS n, round({m}, 6) AS estimate FROM w" for name, (m, n) in {k: _weighted(w) for k, w in ({a: {a: 1} for a in _ARMS} | _CONTRASTS).items()}.items()))
def arms_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's rate, the interaction of four arms and five contrasts, overall and by return flag."""
    return _compared(spark, sf_dir).select("dimension", "group", "name", "n", F.round("estimate", 6).alias("estimate"))


@query()
def contrast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 95 % intervals from draws that all arms and contrasts share; no SQL, as it draws."""
    out = _compared(spark, sf_dir)
    return out.select("dimension", "group", "name", "n", *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")))


def _farthest_sql(k: int) -> str:
    """SQL of ``k`` rounds, one after another."""
    sql = "WITH c0 AS (SELECT label, vec_id, embedding::DOUBLE[] AS x, NULL::DOUBLE AS d, 0 AS rank FROM embeddings WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"
    for r in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(r))
        sql += f""", c{r} AS (
  SELECT e.label, e.vec_id, any_value(e.embedding::DOUBLE[]) AS x, min(list_distance(e.embedding::DOUBLE[], c.x)) AS d, {r} AS rank FROM embeddings e JOIN ({before}) c USING (label)
  WHERE e.vec_id NOT IN (SELECT vec_id FROM ({before})) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY min(list_distance(e.embedding::DOUBLE[], c.x)) DESC, e.vec_id) = 1)"""
    return sql + " SELECT label, vec_id, rank::INT AS rank, round(d, 6) AS distance FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(k)) + ")"


@query(_farthest_sql(4))
def farthest_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors of every label, each the farthest from those before it."""
    got = farthest.farthest_points(table(spark, sf_dir, "embeddings").filter("label IS NOT NULL"), 4, "vec_id", "embedding", ["label"])
    return got.select("label", F.col("id").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


@query("SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1) // 10)::BIGINT AS batch, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1) % 10)::BIGINT AS place FROM orders")
def batches_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority in numbered batches of ten, dearest first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return order.batches(orders, [F.desc("o_totalprice"), "o_orderkey"], 10, ["o_orderpriority"]).drop("o_totalprice")


@query("SELECT 'short batches' AS fault, 0::BIGINT AS n WHERE false UNION ALL SELECT 'repeated keys', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0")
def batches_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of lines in batches of ten: the keys that the table itself repeats, and nothing else."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return order.batch_faults(order.batches(lines, ["l_orderkey", "l_linenumber"], 10), ["l_orderkey", "l_linenumber"], 10, lines.count())


# -- budgets of videos: a part's size and key give a length and a resolution ------------------------------------------------

_SIZES = ["854x480", "720x1280", "clip of 640×360 px", "unknown", "1920 X 800"]


@query("""
WITH p AS (SELECT p_partkey, p_size * 7.25 AS d, [854.0 / 480, 720.0 / 1280, 640.0 / 360, 16.0 / 9, 1920.0 / 800][(p_partkey % 5)::INT + 1]::DOUBLE AS r FROM part),
a AS (SELECT *, ceil(least(d, 300) * 25)::INT + 64 AS audio, least(24000, 32768 - 2048 - 512 - ceil(least(d, 300) * 25)::INT - 64) AS visual FROM p),
f AS (SELECT *, greatest(2, floor(least(d * 2, 300, visual / 100) / 2) * 2)::INT AS n FROM a), t AS (SELECT *, greatest(4, least(256, floor(visual * 2 / n)))::INT AS t FROM f),
u AS (SELECT DISTINCT t, r FROM t), h AS (SELECT t, r, unnest(range(1, t + 1)) AS h FROM u),
w AS (SELECT DISTINCT t, r, h, greatest(1, least(t // h, unnest([floor(r * h)::INT, ceil(r * h)::INT, (t // h)::INT, (t // h - 1)::INT, (t // h - 2)::INT]))) AS w FROM h),
s AS (SELECT *, round(abs(ln(w / h / r)) + 4 * (t - h * w) / t, 9) AS score, round(abs(ln(w / h / r)), 9) AS off FROM w WHERE h * w BETWEEN least(t, 200) AND t),
g AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY t, r ORDER BY score, off, h * w DESC, h, w) = 1)
SELECT p_partkey, n::BIGINT AS frames, (h * 28)::INT AS height, (w * 28)::INT AS width, audio::BIGINT AS audio, (n // 2 * h * w)::BIGINT AS visual, (2048 + audio + n // 2 * h * w + 512)::BIGINT AS checked FROM t JOIN g USING (t, r)
""")
def video_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, size and tokens of a video of a part's length and resolution."""
    size = F.get(F.array(*map(F.lit, _SIZES)), (F.col("p_partkey") % 5).cast("int"))
    planned = budgets.with_video_budgets(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") * 7.25, size, "b")
    return planned.select("p_partkey", *(f"b.{c}" for c in ("frames", "height", "width", "audio", "visual", "checked")))
