"""Substring deduplication by recompression.

Rounds rename every text's token sequence: a round names maximal runs of one
symbol, then pairs of neighbours (a left symbol before a right one, the
alphabet being split by a bit of the symbol's name).  Each round widens the
stretch of words that settles a symbol, so their number follows the window
(:func:`rounds`): as many as leave each window several whole symbols.  Names are 64-bit hashes
of what they replace, so all tasks give equal token strings equal names without
meeting; a symbol depends only on a known stretch of words around it.  Inside
two equal windows, the symbols whose stretch lies inside are therefore equal
and equally placed.  Each window takes one of them as its anchor (highest
level, then least name); windows without any take their own hash.

An anchor held by one document alone rules out all its windows, which leaves
few to verify.  Consecutive windows with one anchor are a stretch; a stretch
that a smaller id holds as a whole, by a 128-bit hash of all its words, is
settled without its windows.  The windows of the other stretches are compared
one by one, by 128-bit hashes, and the smallest id of a window's holders
decides; that holder's own stretch is never a settled one, so none is missed.
Copies of a whole text need no windows: all but the smallest id lose them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import mark_copies
from .filters import passes, repeated
from .session import discard, materialize
from .tokens import SPACED, Words, mix, new_key, ragged, rows_of, window_starts, windows

WINDOW = 13
_RUN, _PAIR, _SIDE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def rounds(window: int) -> int:
    return max(1, int(np.log2(window / 6)))


class Symbols:
    """Symbols over the words of some texts: name, word range, and the word range that settles them.

    A symbol beside a text's first or last word is settled by that limit too,
    so its range is widened past it: no window can hold it.
    """

    def __init__(self, names: np.ndarray, text: np.ndarray, first: np.ndarray):
        at = np.arange(len(names))
        self.name, self.text, self.start, self.stop = names, text, at, at + 1
        self.low, self.high = self.start.copy(), self.stop.copy()

    def _merge(self, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Join each symbol marked as a head with those after it up to the next head."""
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(head)) - 1
        self.low = np.minimum.reduceat(low, at)
        self.high = np.maximum.reduceat(high, at)
        self.name, self.text, self.start, self.stop = name[at], self.text[at], self.start[at], self.stop[last]

    def _reach(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a symbol's left neighbour is in its text, and ranges that take in both neighbours."""
        joined = np.zeros(len(self.name), bool)
        joined[1:] = self.text[1:] == self.text[:-1]
        low, high = self.low.copy(), self.high.copy()
        low[1:] = np.minimum(low[1:], self.low[:-1])
        high[:-1] = np.maximum(high[:-1], self.high[1:])
        low[~joined] = -(1 << 40)
        ends = np.append(~joined[1:], True)
        high[ends] = 1 << 40
        return joined, low, high

    def round(self, level: int) -> None:
        joined, low, high = self._reach()
        same = joined.copy()
        same[1:] &= self.name[1:] == self.name[:-1]
        head = ~same
        length = np.diff(np.append(np.flatnonzero(head), len(head)))
        name = self.name.copy()
        at = np.flatnonzero(head)
        name[at] = mix(self.name[at] ^ (_RUN * (length.astype(np.uint64) + np.uint64(level << 32))))
        self._merge(head, name, low, high)
        joined, low, high = self._reach()
        right = (mix(self.name ^ (_SIDE + np.uint64(level))) & np.uint64(1)).astype(bool)
        second = joined.copy()
        second[1:] &= right[1:] & ~right[:-1]
        name = mix(self.name + np.uint64(level))
        paired = np.flatnonzero(second)
        name[paired - 1] = mix((self.name[paired - 1] * _PAIR) ^ mix(self.name[paired] + np.uint64(level)))
        self._merge(~second, name, low, high)


def anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each window's anchor and its 64-bit hash."""
    at = window_starts(w.counts, w.first, window)
    own = windows(h, window, seed=2)[at]
    best = own.copy()
    if not len(at):
        return at, best, own
    s = Symbols(h, w.row_of(), w.first)
    for level in range(rounds(window)):
        s.round(level)
        # Symbols are in order, and so are the ranges that settle them: a window holds a stretch of symbols.
        keep = np.flatnonzero(s.high - s.low <= window)
        low, high = s.low[keep], s.high[keep]
        # The name takes in the settling words: two words alone recur everywhere, these six or so seldom do.
        name = s.name[keep] ^ _settling_names(h, low, high)
        a, b = np.searchsorted(low, at), np.searchsorted(high, at + window, "right")
        found = np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF))
        for k in range(int(max(0, (b - a).max(initial=0)))):
            live = a + k < b
            i = np.minimum(a + k, max(len(name) - 1, 0))
            found[live] = np.minimum(found[live], name[i[live]])
        best = np.where(a < b, found, best)
    return at, best, own


def _unique_anchors(window: int, key: int):
    """The distinct anchors of each text, text after text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in rows_of(batches, "text"):
            w = Words(batch.column("text"), SPACED, lower=False)
            at, anchor, _ = anchors(w, w.hashes(key), window)
            text = np.searchsorted(w.first, at, "right")
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(at) else np.zeros(0, bool)
            anchor, text = anchor[new], text[new]
            order = np.lexsort((anchor, text))
            anchor, text = anchor[order], text[order]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(anchor) else new
            yield anchor[new]

    return run


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


_STEP = np.uint64(0x9E6C63D0876A9A47)


def _settling_names(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A name of the words in each range, good enough to rule windows out; what is removed is told by :func:`_stretch_digests`."""
    power, back = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(h), x, np.uint64)))) for x in (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)))
    return mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def _stretch_digests(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each range's words, which are rows of 128 bits themselves, by a cryptographic hash, as two columns."""
    raw = np.ascontiguousarray(words).tobytes()
    both = b"".join([hashlib.blake2b(raw[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist())])
    got = np.frombuffer(both, np.int64).reshape(-1, 2)
    return got[:, 0].copy(), got[:, 1].copy()


def _scan(docs: DataFrame, flags, window: int, key: int) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (null: in doubt), raw (in doubt only), found: the stretches in doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            w = Words(batch.column("text"), SPACED, lower=False)
            h = w.hashes(key)
            at, anchor, _ = anchors(w, h, window)
            text = np.searchsorted(w.first, at, "right") - 1
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            hit = passes(flags.value, anchor) & ~copy[text]
            at, anchor, text = at[hit], anchor[hit], text[hit]
            head = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])) if len(at) else np.zeros(0, bool)
            begin = at[head]
            count = np.diff(np.append(np.flatnonzero(head), len(head)))
            r1, r2 = _stretch_digests(np.stack((h, w.hashes(key + 1)), axis=1) if len(begin) else h, begin, begin + count + window - 1)
            cut = np.searchsorted(begin, w.first)
            place = begin - np.repeat(w.first[:-1], np.diff(cut))
            found = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(r1), pa.array(r2), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))], ["r1", "r2", "place", "n"]))
            gone, doubt = copy & (w.counts >= window), np.diff(cut) > 0
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            kept = [None if d else b"" if g else b" ".join((x or b"").split()) for g, d, x in zip(gone, doubt, raw)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(w.counts), pa.array(np.where(gone, w.counts, 0)), pa.array([None if x is None else _digest(x) for x in kept], pa.string()), pa.array([x if d else None for d, x in zip(doubt, raw)], pa.binary()), found],
                names=["id", "n_words", "n_removed", "kept_sha256", "raw", "found"],
            )

    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, raw binary, found array<struct<r1:long,r2:long,place:int,n:int>>")


def _open_windows(rows: DataFrame, window: int, key: int) -> DataFrame:
    """row, id, h1, h2, place of the windows of stretches that are not settled (``open``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "raw"):
            w = Words(batch.column("raw").cast(pa.string()), SPACED, lower=False)
            h = w.hashes(key), w.hashes(key + 1)
            lists = batch.column("open").to_pylist()
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            n = np.array([s["n"] for x in lists for s in x], np.int64)
            place = ragged(np.array([s["place"] for x in lists for s in x], np.int64), n)
            row = np.repeat(row, n)
            at = w.first[row] + place
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("id").take(take), *(pa.array(windows(h[k], window, seed=k + 2)[at].view(np.int64)) for k in (0, 1)), pa.array(place.astype(np.int32))], names=["row", "id", "h1", "h2", "place"]
            )

    return rows.mapInArrow(run, "row long, id long, h1 long, h2 long, place int")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Take the covered words out of the texts in doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "raw"):
            kept, removed = [], []
            for raw, ranges in zip(batch.column("raw").to_pylist(), batch.column("gone").to_pylist()):
                words = raw.split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.array([r["place"] for r in ranges or ()], np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + np.array([r["n"] for r in ranges or ()], np.int64) + window - 1, -1)
                stay = np.cumsum(edge[:-1]) == 0
                removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stay) if s]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array([_digest(k) for k in kept], pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bits: int = 27) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Each word inside a run of ``window`` words that also starts in a document
    with a smaller id goes.  A null text has no words.  Rows repeating an id
    are one document in this respect: they take nothing from each other.  A
    row with a null id loses nothing and makes no other row lose anything.  A
    run that occurs in several documents stays in the one with the smallest id,
    so there is no tie.  A very long text is a slice of its own in a task and is
    looked through whole.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    context, key = docs.sparkSession.sparkContext, new_key()
    marked = mark_copies(docs).select("id", "text", "copy")
    flags = context.broadcast(repeated(marked.filter("NOT copy").select("text"), _unique_anchors(window, key), bits))
    scanned = materialize(_scan(marked, flags, window, key).withColumn("row", F.monotonically_increasing_id()))
    sure = scanned.filter("kept_sha256 IS NOT NULL").select("id", "n_words", "n_removed", "kept_sha256")
    doubtful = scanned.filter("kept_sha256 IS NULL")
    held = doubtful.select("row", "id", F.explode("found").alias("f")).select("row", "id", "f.*")
    shared = held.groupBy("r1", "r2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("r1", "r2", "least")
    settled = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    item = F.struct("place", "n")
    lists = materialize(
        held.join(shared, ["r1", "r2"], "left").groupBy("row").agg(F.collect_list(F.when(settled, item)).alias("gone"), F.collect_list(F.when(~settled, item)).alias("open"))
    )
    texts = doubtful.select("row", "id", "raw").filter("id IS NOT NULL")
    held = materialize(_open_windows(texts.join(lists.filter(F.size("open") > 0).select("row", "open"), "row"), window, key))
    shared = held.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("h1", "h2", "least")
    more = held.join(shared, ["h1", "h2"]).filter("id > least").groupBy("row").agg(F.collect_list(F.struct("place", F.lit(1).alias("n"))).alias("more"))
    gone = materialize(lists.select("row", "gone").join(more, "row", "left").select("row", F.concat("gone", F.coalesce("more", F.array().cast("array<struct<place:int,n:int>>"))).alias("gone")))
    discard(held)
    discard(lists)
    return sure.unionByName(_cut(doubtful.select("row", "id", "n_words", "raw").join(gone, "row", "left").select("id", "n_words", "raw", "gone"), window))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (win) WHERE doc_id > least),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (
  SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS n_removed
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
