"""Line deduplication against levelled sorted runs.  DataFrame functions only.

The store holds, for every long line key seen, its 128-bit hash, the document
that keeps it and how many documents have held it since.  Documents come in
batches from the largest id down, so the first document to bring a key is the
one that keeps it.  Each batch is counted by key, then merge-anti-joined with
the runs: unseen keys become a new sorted run of level 0, seen ones a sorted
run of further counts.  When a level has FAN_IN runs they are merged into one
run of the next level, so a batch meets at most FAN_IN runs for each level and
a key is rewritten once per level.  All runs are bucketed and sorted by the
hash alike, so these joins need no shuffle of the runs.

Skew: a line is counted per task before the shuffle, so a key held by a third
of all documents is a row per task; where dropped keys meet their documents'
lines, a plain join lets Spark split a hot key.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import materialize, partitions

#: White space stripped from both ends of a key: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FAN_IN = 4, 2


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased (other letters as they are)."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def key_hash(line: Column, min_chars: int) -> Column:
    """Two 64-bit hashes of the line's key; null where the key is short."""
    bare = F.btrim(line, F.lit(SPACES))
    key = line_key(line)
    return F.when(F.length(bare) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


class LineStore:
    """Levelled runs of line hashes: ``runs`` (h1, h2, keeper, n) and ``again`` (h1, h2, n) as tables of the warehouse."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = partitions(spark)
        self.runs: dict[int, list[str]] = {}
        self.again: dict[int, list[str]] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
            .write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        )
        return name

    def _level(self, levels: dict[int, list[str]], merge) -> None:
        """Merge every full level into one run of the next."""
        level = 0
        while len(levels.get(level, [])) >= self.fan_in:
            old = levels.pop(level)
            tables = [self.spark.table(t) for t in old]
            whole = tables[0]
            for t in tables[1:]:
                whole = whole.unionByName(t)
            levels.setdefault(level + 1, []).append(self._write(merge(whole)))
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            level += 1

    def add(self, counted: DataFrame) -> None:
        """Take a batch (h1, h2, keeper, n: one row per key): unseen keys make a run, seen ones count."""
        batch = self.spark.table(name := self._write(counted))
        fresh, seen = batch, None
        for table in (t for level in sorted(self.runs, reverse=True) for t in self.runs[level]):
            run = self.spark.table(table).select("h1", "h2")
            met = batch.join(run, ["h1", "h2"], "left_semi").select("h1", "h2", "n")
            seen = met if seen is None else seen.unionByName(met)
            fresh = fresh.join(run, ["h1", "h2"], "left_anti")
        self.runs.setdefault(0, []).append(self._write(fresh))
        if seen is not None:
            self.again.setdefault(0, []).append(self._write(seen))
        self.spark.sql(f"DROP TABLE {name}")
        self._level(self.runs, lambda runs: runs)  # the anti-join has made keys distinct
        self._level(self.again, lambda runs: runs.groupBy("h1", "h2").agg(F.sum("n").alias("n")))

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys held by at least ``min_docs`` documents: h1, h2, keeper."""
        all_runs = [self.spark.table(t).select("h1", "h2", "keeper", "n") for ts in self.runs.values() for t in ts]
        all_runs += [self.spark.table(t).select("h1", "h2", F.lit(None).cast("long").alias("keeper"), "n") for ts in self.again.values() for t in ts]
        whole = all_runs[0]
        for t in all_runs[1:]:
            whole = whole.unionByName(t)
        return whole.groupBy("h1", "h2").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2", "keeper")

    def drop(self) -> None:
        for ts in [*self.runs.values(), *self.again.values()]:
            for t in ts:
                self.spark.sql(f"DROP TABLE {t}")
        self.runs, self.again = {}, {}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with three more columns: n_lines, n_dropped, kept_text.

    Keys (see :func:`line_key`) of at least ``min_chars`` code points in at
    least ``min_docs`` documents lose their lines except in the largest id
    holding them.  A null or empty text is one empty line and is kept (as an
    empty text).  Rows that repeat an id count as one document and are treated
    alike; a row with a null id keeps all its lines and counts for no key.
    A line is hashed once, and a text loses its lines by their places, so the
    work follows the length of a text however many of its lines are lost.
    ``docs`` must have no columns of the three new names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    row = {"__id": F.col(id_col).cast("long"), "__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)}
    keyed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), key_hash(x, min_chars).alias("h"))), lambda k: k["h"].isNotNull())
    held = docs.filter(F.col(id_col).isNotNull()).select(*(c.alias(n) for n, c in row.items()), F.explode(keyed).alias("k"))
    held = materialize(held.select(*row, "k.pos", "k.h.h1", "k.h.h2"))
    ids = docs.select(row["__id"].alias("__id")).filter(F.col("__id").isNotNull())
    edges = ids.approxQuantile("__id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = [None, *sorted(set(edges), reverse=True), None]
    store = LineStore(spark)
    try:
        for high, low in zip(cuts, cuts[1:]):
            batch = held
            if high is not None:
                batch = batch.filter(F.col("__id") <= int(high))
            if low is not None:
                batch = batch.filter(F.col("__id") > int(low))
            once = batch.select("h1", "h2", "__id").distinct()
            store.add(once.groupBy("h1", "h2").agg(F.max("__id").alias("keeper"), F.count("*").alias("n")))
        frequent = materialize(store.frequent(min_docs))
    finally:
        store.drop()
    lost = held.join(frequent, ["h1", "h2"]).filter(F.col("__id") != F.col("keeper")).groupBy(*row).agg(F.collect_set("pos").alias("__lost"))
    joined = docs.withColumns({k: c for k, c in row.items()}).join(lost, list(row), "left").drop(*row)
    count = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), count - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return joined.withColumn("__lines", lines).withColumns(
        {"n_lines": count.cast("long"), "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"), "kept_text": kept}
    ).drop("__lost", "__lines")


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.i, l.line, (f.k IS NOT NULL AND f.keeper <> l.doc_id) AS lost FROM l LEFT JOIN f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
