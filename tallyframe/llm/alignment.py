"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both encoders' tokens are given by where they end.  While the end arrays agree
at the current index shift, tokens correspond one to one, and exponential
probing jumps over the whole stretch: ever longer slices of the arrays are
compared until one differs, then the first difference is found in it.  An
irregular group is settled locally, by advancing whichever side ends first
until both end at the same byte, and the shift is updated by the difference of
the group's sizes.

Token texts are cut into pieces that neither encoder's tokens span (see
pieces.py).  In a task the distinct new pieces of a slice are put one after
another and aligned as one text, and what a piece gives is remembered.  Links
are counted per slice, then by Spark over all documents.  The most frequent
pairs go to every task as one bounded table; links of all other pairs are
joined with their counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import ByteLevel, SentencePieces
from .pieces import Remembered, cut
from .session import bound_batches, materialize
from .tokens import binary_rows, ragged, rows_of

#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Pairs whose counts are sent to every task (20 bytes each); the others' links are joined.
FREQUENT = 1_000_000


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of tokens that ends at a byte where tokens of both sides end: its last token's number plus one, on either side.

    ``a`` and ``b`` ascend, hold positive ends and have the same last entry.
    """
    x, y = a.tolist(), b.tolist()
    n, m, i, j = len(x), len(y), 0, 0
    stretches: list[tuple[int, int, int]] = []  # first and last group's end on the left, and the shift
    while i < n:
        begin, step = i, 1
        while i < n and j < m:
            k = min(step, n - i, m - j)
            if x[i : i + k] == y[j : j + k]:
                i += k
                j += k
                step *= 2
            else:
                while k > 1:  # the first difference, by halves
                    half = k // 2
                    if x[i : i + half] == y[j : j + half]:
                        i += half
                        j += half
                        k -= half
                    else:
                        k = half
                break
        if i > begin:
            stretches.append((begin + 1, i, j - i))
        if i >= n:
            break
        p, q = x[i], y[j]
        i += 1
        j += 1
        while p != q:
            if p < q:
                p = x[i]
                i += 1
            else:
                q = y[j]
                j += 1
        stretches.append((i, i, j - i))
    if not stretches:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last, shift = np.array(stretches, np.int64).T
    size = last - first + 1
    left = ragged(first, size)
    return left, left + np.repeat(shift, size)


def links(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens whose byte ranges overlap: numbers of both, and how many each group has.

    Inside a group no two ends agree but the last, so each end starts one more pair.
    """
    size_a, size_b = np.diff(left, prepend=0), np.diff(right, prepend=0)
    count = size_a + size_b - 1
    ends = np.sort(np.concatenate((a, np.delete(b, right - 1))), kind="stable")  # one link ends at each of them
    return np.searchsorted(a, ends), np.searchsorted(b, ends), count


class Aligner:
    """Pieces of text, encoded by both vocabularies and aligned."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, special=False), SentencePieces(path_b)
        # An id in digits and what follows it: 2 id for one inside its group, 2 id + 1 for a group's last; b's entries after a's.
        self.names = [b"%d%s" % (i, sign) for x, signs in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for i in range(len(x.bytes)) for sign in signs]
        self.name_size = np.array([len(n) for n in self.names], np.int64)
        self.of = Remembered(self.make, lambda x: 260 if x is False else 260 + len(x[3]) + len(x[4]))

    def make(self, pieces: list[bytes]) -> list:
        """For each piece (n_a, n_b, n_groups, groups as text, links as pairs of unsigned 32-bit ids), or False where the tokens' bytes are not the piece."""
        (ia, fa), (ib, fb) = self.a.pieces(pieces), self.b.pieces(pieces)
        which = np.arange(len(pieces))
        out: list = [False] * len(pieces)
        whole, ta, tb = b"".join(pieces), ia.tolist(), ib.tolist()
        if not (whole == b"".join(map(self.a.bytes.__getitem__, ta)) == b"".join(map(self.b.bytes.__getitem__, tb))):
            ca, cb = fa.tolist(), fb.tolist()
            good = [p == b"".join(map(self.a.bytes.__getitem__, ta[ca[k] : ca[k + 1]])) == b"".join(map(self.b.bytes.__getitem__, tb[cb[k] : cb[k + 1]])) for k, p in enumerate(pieces)]
            which = np.flatnonzero(good)
            ia, ib = ia[ragged(fa[which], np.diff(fa)[which])], ib[ragged(fb[which], np.diff(fb)[which])]
        if not len(which):
            return out
        ea, eb = np.cumsum(self.a.width[ia]), np.cumsum(self.b.width[ib])
        left, right = aligned(ea, eb)
        la, lb, per = links(ea, eb, left, right)
        pairs = np.stack((ia[la], ib[lb]), axis=1).astype("<u4").tobytes()
        # All ids in the order of the text of groups: a group's a-tokens, then its b-tokens.
        last_a, last_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        last_a[left - 1] = last_b[right - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        names = np.empty(len(ia) + len(ib), np.int64)
        names[np.arange(len(ia)) + np.append(0, right)[group_a]] = ia.astype(np.int64) * 2 + last_a
        names[np.arange(len(ib)) + left[group_b]] = (len(self.a.bytes) + ib.astype(np.int64)) * 2 + last_b
        text = b"".join(map(self.names.__getitem__, names.tolist()))
        group_end = np.cumsum(self.name_size[names])[left + right - 1]
        # A piece's tokens, groups and links end where its bytes do.
        to = np.searchsorted(ea[left - 1], np.cumsum([len(pieces[k]) for k in which.tolist()]), side="right")
        ends = np.stack((left[to - 1], right[to - 1], to, group_end[to - 1], np.cumsum(per)[to - 1] * 8))
        begins = np.concatenate((np.zeros((5, 1), np.int64), ends[:, :-1]), axis=1)
        counts = (ends[:3] - begins[:3]).tolist()
        for k, a, b, g, t1, t2, x1, x2 in zip(which.tolist(), *counts, begins[3].tolist(), (ends[3] - 1).tolist(), begins[4].tolist(), ends[4].tolist()):
            out[k] = (a, b, g, text[t1:t2], pairs[x1:x2])
        return out


@functools.lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links (long), groups (text), pairs (binary: links in order, each two little-endian unsigned 32-bit ids).

    Both encode a space and the text, strings of special tokens being plain
    text.  groups lists a1,a2|b1;a3|b2,b3: ids by group.  A text that is null
    or empty, or of which either side's tokens join to other bytes, has zeros,
    an empty text and no pairs.  Each row of ``docs`` gives one row, repeated
    and null ids included; a very long text is a slice of its own.
    """
    bound_batches(docs.sparkSession)
    names = list(dict.fromkeys(keep))
    df = docs.select(*names, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _aligner(path_a, path_b).of
        for batch in rows_of(batches, "__text", SLICE):
            texts = pc.fill_null(batch.column("__text"), "")
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
            which, first, distinct = cut(texts)
            made = of(distinct)
            bad = np.array([x is False for x in made], bool)
            sizes = np.array([(0, 0, 0, 0) if x is False else (*x[:3], len(x[4]) // 8) for x in made], np.int64).reshape(-1, 4)
            rows = first.tolist()
            broken = np.diff(np.append(0, np.cumsum(bad[which]))[first]) > 0
            total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(sizes[which], axis=0)))
            total = np.where(broken[:, None], 0, np.diff(total[first], axis=0))
            text, pairs = [b"" if x is False else x[3] for x in made], [b"" if x is False else x[4] for x in made]
            places, gone = which.tolist(), broken.tolist()
            spans = [places[a:b] if not g else () for a, b, g in zip(rows, rows[1:], gone)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names), *(pa.array(total[:, c]) for c in range(4)),
                    pa.array([b";".join(map(text.__getitem__, s)) for s in spans], pa.binary()).cast(pa.string()), pa.array([b"".join(map(pairs.__getitem__, s)) for s in spans], pa.binary()),
                ],
                names=[*names, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    return df.mapInArrow(run, f"{kept}{', ' if kept else ''}n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary")


def _codes(pairs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The links of a pairs column as 64-bit codes (id of b above id of a), and the rows' offsets."""
    pairs = pc.cast(pairs, pa.large_binary())
    at = np.frombuffer(pairs.buffers()[1], np.int64, len(pairs) + 1, pairs.offset * 8)
    raw = np.frombuffer(pairs.buffers()[2] or b"", "<u4", count=int(at[-1] - at[0]) // 4, offset=int(at[0])).astype(np.uint64).reshape(-1, 2)
    return (raw[:, 1] << np.uint64(32) | raw[:, 0]).astype(np.int64), (at - at[0]) // 8


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (links that hold the pair) and best (whether no other a has more links with this b) over a ``pairs`` column of :func:`align`.

    Links are counted inside tasks first, so a pair is shuffled once a task.
    """
    bound_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            c, n = np.unique(_codes(batch.column(0))[0], return_counts=True)
            codes, back = np.unique(np.concatenate((codes, c)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n)), len(codes)).astype(np.int64)
            if len(codes) > 4 * FREQUENT:  # the table of a task stays bounded
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])
                codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    n = materialize(pairs.select("pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    b = F.shiftright("code", 32)
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row an id of the vocabulary
    return n.select(F.col("code").bitwiseAND((1 << 32) - 1).alias("a"), b.alias("b"), "n").join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def score(rows: DataFrame, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",), frequent: int = FREQUENT) -> DataFrame:
    """``keep`` columns, n_best and count_sum of every row of :func:`align`: how many links have their b's best pair, and the sum of all links' counts.

    ``counts`` comes from :func:`pair_counts`.  The ``frequent`` most frequent
    pairs go to all tasks; links of others are shuffled, counted per row first.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    names = list(dict.fromkeys(keep))
    counts = materialize(counts)
    code = F.shiftleft("b", 32).bitwiseOR(F.col("a"))
    within = counts.count() <= frequent
    top = (counts if within else counts.orderBy(F.desc("n"), "b", "a").limit(frequent)).select(code.alias("code"), "n", "best").toArrow().sort_by("code")
    sent = spark.sparkContext.broadcast(tuple(top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in top.column_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            codes, at = _codes(batch.column("pairs"))
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            there = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            sums = np.zeros((2, len(codes) + 1), np.int64)
            if len(known):
                np.cumsum(np.where(there, best[place], False), out=sums[0, 1:])
                np.cumsum(np.where(there, n[place], 0), out=sums[1, 1:])
            sums = np.diff(sums[:, at], axis=1)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))[~there]
            rest = codes[~there].tolist()
            own = np.searchsorted(row, np.arange(len(at))).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sums[0]), pa.array(sums[1]), pa.array([rest[a:b] for a, b in zip(own, own[1:])], pa.list_(pa.int64()))], names=[*names, "n_best", "count_sum", "rest"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    out = rows.select(*names, "pairs").mapInArrow(run, f"{kept}{', ' if kept else ''}n_best long, count_sum long, rest array<long>")
    if within:
        return out.drop("rest")
    out = materialize(out.withColumn("__row", F.expr("uuid()")))  # rows may repeat an id
    loose = out.select("__row", F.explode("rest").alias("code")).groupBy("__row", "code").agg(F.count("*").alias("times"))
    loose = loose.join(counts.select(code.alias("code"), "n", "best"), "code").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    both = out.join(loose, "__row", "left")
    return both.select(*names, (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"))
