"""Benchmark decontamination: a prefix-filtered containment join.

An item's windows (13 consecutive words) are sets of 4-word shingles.  Shingles
are ordered by rarity, counted over all documents.  A document that contains a
window contains all its shingles, so the necessary prefix of a window is its
rarest shingle alone: documents are joined with windows on that one.  The place
of the shingle in window and document bounds where the window can lie, and
words are then compared one by one over the item-sized window.

Passes over the documents: one counts the items' shingles, one finds prefix
shingles.  Both drop other shingles by a filter of fixed size before anything
is shuffled.  The windows are broadcast if a count shows them to be few, and
else joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import bitmap, passes
from .session import materialize, small
from .tokens import ALNUM, Words, rows_of, window_starts, windows

WINDOW, SHINGLE = 13, 4
#: Prefix rows up to which they are broadcast (some 300 bytes each).
BROADCAST_ROWS = 50_000
#: Least share of a document's words inside benchmark windows: one in 20.
SHARE = 20


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every ``k``-word shingle."""
    at = window_starts(w.counts, w.first, k)
    row = np.searchsorted(w.first, at, "right") - 1
    return windows(w.hashes(), k, seed=k)[at], row, at - w.first[row]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text")).filter("text IS NOT NULL")


def item_shingles(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """key, place, h, width: the shingles of each distinct item text (an item shorter than a shingle is one of its own width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            w = Words(batch.column("text"), ALNUM)
            n = w.counts
            for k in range(1, shingle + 1):
                h, row, place = _shingles(w, k)
                fit = n[row] == k if k < shingle else n[row] >= k
                keys = batch.column("key").take(pa.array(row[fit]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(place[fit]), pa.array(h[fit].view(np.int64)), pa.array(np.full(fit.sum(), k, np.int64))], names=["key", "place", "h", "width"])

    return items.select("key", "text").dropDuplicates(["key"]).mapInArrow(run, "key string, place long, h long, width long")


def _document_shingles(docs: DataFrame, widths: list[int], flags) -> DataFrame:
    """h, n: in how many documents of a slice each of the filter's shingles is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 4 << 20):
            w = Words(batch.column("text"), ALNUM)
            for k in widths:
                h, row, _ = _shingles(w, k)
                hit = passes(flags.value, h)
                pairs = np.unique(np.rec.fromarrays([h[hit], row[hit]]))
                h, n = np.unique(pairs["f0"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long")


def prefixes(items: DataFrame, rarity: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row for each run of windows with one rarest shingle.

    h, key, words (of all those windows, by a space), at (the shingle's place
    in them), width, size (words in a window).
    """
    shingles = item_shingles(items, window, shingle)
    ranked = shingles.join(rarity, "h", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "h", "width"))).alias("s"))
    texts = items.select("key", "text").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            w = Words(batch.column("text"), ALNUM)
            out = []
            for r, (key, s) in enumerate(zip(batch.column("key").to_pylist(), batch.column("s").to_pylist())):
                words = [w.word(i).decode() for i in range(w.first[r], w.first[r + 1])]
                size, width = min(window, len(words)), s[0]["width"]
                best = [min((s[j]["n"], s[j]["h"], j) for j in range(i, i + size - width + 1))[2] for i in range(len(words) - size + 1)]
                i = 0
                while i < len(best):
                    e = i
                    while e + 1 < len(best) and best[e + 1] == best[i]:
                        e += 1
                    out.append((s[best[i]]["h"], key, " ".join(words[i : e + size]), best[i] - i, width, size))
                    i = e + 1
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "key", "words", "at", "width", "size"), o)) for o in out], schema=_PREFIX)

    return texts.join(ranked, "key").mapInArrow(run, "h long, key string, words string, at long, width long, size long")


_PREFIX = pa.schema([("h", pa.int64()), ("key", pa.string()), ("words", pa.string()), ("at", pa.int64()), ("width", pa.int64()), ("size", pa.int64())])


def _candidates(docs: DataFrame, widths: list[int], flags, window: int) -> DataFrame:
    """doc_id, th, n_words, found: places of prefix shingles with the words around them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("h", pa.int64()), ("width", pa.int64()), ("place", pa.int64()), ("left", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            w = Words(batch.column("text"), ALNUM)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for k in widths:
                h, row, place = _shingles(w, k)
                for i in np.flatnonzero(passes(flags.value, h)):
                    r, p = row[i], place[i]
                    a, b = max(0, p - (window - k)), min(w.counts[r], p + window)
                    words = b" ".join([w.word(j) for j in range(w.first[r] + a, w.first[r] + b)]).decode()
                    found[r].append({"h": int(h[i].view(np.int64)), "width": k, "place": int(p), "left": int(p - a), "words": words})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(w.counts), pa.array(found, pa.list_(struct))], names=["doc_id", "th", "n_words", "found"]
            )

    return docs.mapInArrow(run, f"doc_id {kind}, th long, n_words long, found array<struct<h:long,width:long,place:long,left:long,words:string>>")


def _verified(pairs: DataFrame) -> DataFrame:
    """doc_id, th, key, start, stop: the words of a document that verified windows of an item cover."""
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, start, stop = [], [], []
            cols = (batch.column(c).to_pylist() for c in ("place", "left", "words", "at", "width", "size", "item_words"))
            for i, (place, left, words, at, width, size, item) in enumerate(zip(*cols)):
                d, m = words.split(" "), item.split(" ")
                if d[left : left + width] != m[at : at + width]:
                    continue
                a = 0
                while a < min(left, at) and d[left - a - 1] == m[at - a - 1]:
                    a += 1
                b = width
                while left + b < len(d) and at + b < len(m) and d[left + b] == m[at + b]:
                    b += 1
                if a + b >= size:
                    keep.append(i)
                    start.append(place - a)
                    stop.append(place + b)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "th", "key")), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "th", "key", "start", "stop"])

    return pairs.mapInArrow(run, f"doc_id {kind}, th long, key string, start long, stop long")


def text_hash(text: str) -> Column:
    """By which rows that repeat an id are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (:func:`text_hash`), n_words, n_hit, hits (word ranges), items (sorted as strings), contaminated.

    Words are ASCII letters and digits (A-Z lower-cased) and anything beyond
    ASCII.  An item of fewer than ``window`` words, but not none, is one
    window.  Null texts have no words; items without words occur nowhere; a
    null item id marks words as hit but is not listed.  Rows repeating an id,
    even a null one, are judged each by its own text.  A very long text is a
    slice of its own in a task and is looked through whole; items with equal
    windows are all listed, and a share of exactly a twentieth is contaminated.
    Other columns are not read, so their names cannot clash.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    items = materialize(_items(benchmark, item_col, item_text))
    shingles = materialize(item_shingles(items, window, shingle))
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # at most `shingle` rows
    counted = _document_shingles(docs, widths, context.broadcast(bitmap(shingles, "h")))
    rarity = counted.groupBy("h").agg(F.sum("n").alias("n"))
    prefix = materialize(prefixes(items, rarity, window, shingle))
    scanned = materialize(_candidates(docs, widths, context.broadcast(bitmap(prefix, "h")), window))
    found = scanned.filter(F.size("found") > 0).select("doc_id", "th", F.explode("found").alias("f")).select("doc_id", "th", "f.*")
    pairs = found.join(small(prefix.withColumnRenamed("words", "item_words"), BROADCAST_ROWS), ["h", "width"])
    hits = materialize(_verified(pairs))
    ordered = F.sort_array(F.collect_set(F.struct("start", "stop")))
    names = hits.join(small(items.select("key", "item").distinct(), BROADCAST_ROWS), "key").groupBy("doc_id", "th").agg(
        ordered.alias("hits"), F.sort_array(F.collect_set("item")).alias("items")
    ).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hits", "items")
    out = scanned.select("doc_id", "th", "n_words").join(names, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["stop"]).alias("to")),
        lambda acc: acc["n"],
    )
    return out.select(
        "doc_id", "th", "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"), "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), m AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
