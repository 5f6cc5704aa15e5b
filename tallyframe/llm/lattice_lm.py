"""Language-model scores from a subword lattice.

Every word, with a word-start mark before it, is a lattice of the existing
vocabulary's pieces and single bytes.  Pieces start from the vocabulary's own
scores and are re-estimated on the training documents' distinct words by
expectation maximisation; the marginal over all segmentations comes from a
forward recursion in log space.  A word of the training documents is one more
edge, over the whole word, weighted by its discounted count; the discount is
what all other segmentations share.  A text's probability is the product over
its words and one end.

Gathered from the corpus: a table of all distinct words with their training
counts, built by hash range so that no task holds more than a range; its size
follows the input.  Documents look up frequent words in a broadcast table of
at most FREQUENT entries, which takes hot words off the shuffle; their other
words are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import hash_ranges
from .session import discard, materialize
from .tokens import SPACED, Words, new_key, ragged, rows_of

#: Most words of the broadcast table (20 bytes each).
FREQUENT = 500_000
EM_ROUNDS = 5
#: Every piece's count before any is seen.
PRIOR = 0.05
MARK = "▁".encode()
_LOG10 = np.log(10.0)


class Pieces:
    """A trie over the vocabulary's pieces and the 256 bytes, with first log-probabilities from the vocabulary's scores.

    The scores of a merge vocabulary are ranks, so the first weights fall off
    with the rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
                texts[model.id_to_piece(i).encode()] = 1 / (10 - model.get_score(i))
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, text in enumerate(texts):
            node = 0
            for b in text:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = k
        self.next = np.zeros((len(children), 256), np.int32)  # 0: no way on
        for node, ways in enumerate(children):
            for b, to in ways.items():
                self.next[node, b] = to
        self.piece = np.array(ends, np.int32)
        weights = np.array([*texts.values()])
        self.log_p = np.log(weights / weights.sum())


class Lattice:
    """All segmentations of some words (bytes in one buffer, ``start`` and ``size`` of each, the mark included)."""

    def __init__(self, pieces: Pieces, data: np.ndarray, size: np.ndarray):
        self.start = np.cumsum(size) - size
        self.size, self.n = size, len(data)
        stop = np.repeat(self.start + size, size)
        at = np.arange(len(data))
        node, here, first = np.zeros(len(data), np.int32), at, at
        begin, end, piece = [], [], []
        while len(here):
            node = pieces.next[node, data[here]]
            here = here + 1
            live = node > 0
            node, here, first = node[live], here[live], first[live]
            hit = pieces.piece[node]
            got = hit >= 0
            begin.append(first[got]), end.append(here[got]), piece.append(hit[got])
            live = here < stop[first]
            node, here, first = node[live], here[live], first[live]
        begin, end, piece = np.concatenate(begin), np.concatenate(end), np.concatenate(piece)
        # Node ids: a word of s bytes has s + 1 nodes.
        word = np.repeat(np.arange(len(size)), size)[begin]
        self.begin, self.end, self.piece = begin + word, end + word, piece
        self.zero = self.start + np.arange(len(size))
        self.depth_end, self.depth_begin = end - self.start[word], begin - self.start[word]
        self.word = word

    def _sweep(self, order: np.ndarray, depth: np.ndarray, to: np.ndarray, frm: np.ndarray, log_p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-sums over paths: edges in ``order`` of depth, each target's edges side by side."""
        total = np.full(self.n + len(self.size), -np.inf)
        total[first] = 0.0
        depth, to, frm, log_p = depth[order], to[order], frm[order], log_p[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]))
        heads = np.concatenate(([True], (np.diff(to) != 0) | (np.diff(depth) != 0))) if len(to) else np.zeros(0, bool)
        for a, b in zip(cuts, cuts[1:]):
            x = total[frm[a:b]] + log_p[a:b]
            h = np.flatnonzero(heads[a:b])
            most = np.maximum.reduceat(x, h)
            width = np.diff(np.concatenate((h, [b - a])))
            total[to[a:b][h]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, width)), h))
        return total

    def forward(self, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of every prefix, and of every word."""
        alpha = self._sweep(np.lexsort((self.end, self.depth_end)), self.depth_end, self.end, self.begin, log_p[self.piece], self.zero)
        return alpha, alpha[self.zero + self.size]

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` copies of each word."""
        alpha, whole = self.forward(log_p)
        beta = self._sweep(np.lexsort((self.begin, -self.depth_begin)), -self.depth_begin, self.begin, self.end, log_p[self.piece], self.zero + self.size)
        share = np.exp(alpha[self.begin] + log_p[self.piece] + beta[self.end] - whole[self.word]) * counts[self.word]
        return np.bincount(self.piece, share, len(log_p))


def lattices(pieces: Pieces, words: pa.Array, most: int = 1 << 19) -> Iterator[tuple[Lattice, int, int]]:
    """Lattices of words, some hundred kilobytes of text at a time."""
    size = np.array([len(w) for w in words.to_pylist()], np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            raw = [MARK + w for w in words.slice(a, b - a).to_pylist()]
            yield Lattice(pieces, np.frombuffer(b"".join(raw), np.uint8), size[a:b] + len(MARK)), a, b


def vocabulary(docs: DataFrame, key: int) -> DataFrame:
    """h (under ``key``), word, c (training count): all distinct words of ``text``; ``train`` says which rows count."""
    shift = hash_ranges(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 8 << 20):
            w = Words(batch.column("text"), SPACED)
            if not len(w):
                continue
            train = np.repeat(np.array(batch.column("train").to_pylist(), bool), w.counts)
            h, where, which = np.unique(w.hashes(key), return_index=True, return_inverse=True)
            c = np.bincount(which, train, len(h)).astype(np.int64)
            size = (w.end - w.start)[where]
            data = w.data[ragged(w.start[where], size)]
            part = (h >> np.uint64(64 - shift)).astype(np.int64)
            at = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(h)]))
            bytes_at = np.concatenate(([0], np.cumsum(size)))[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at[:-1]]), *(_blobs(x, at) for x in (h, c, size.astype(np.int64))), _blobs(data, bytes_at)], names=["part", "h", "c", "size", "data"]
            )

    def own(key: tuple, got: pa.Table) -> pa.Table:
        h, c, size, data = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in got.column(n).combine_chunks()]) for n, t in (("h", np.uint64), ("c", np.int64), ("size", np.int64), ("data", np.uint8)))
        h, where, which = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(which, c, len(h)).astype(np.int64)
        start = (np.cumsum(size) - size)[where]
        size = size[where]
        at = np.concatenate(([0], np.cumsum(size)))
        return pa.table({"h": h.view(np.int64), "word": _blobs(data[ragged(start, size)], at), "c": c})

    packed = docs.select("text", "train").mapInArrow(pack, "part long, h binary, c binary, size binary, data binary")
    return packed.groupBy("part").applyInArrow(own, "h long, word binary, c long")


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = pa.py_buffer(np.ascontiguousarray(values))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at * values.itemsize, np.int64)), raw]).cast(pa.binary())


def train(vocab: DataFrame, pieces_path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log-probabilities of the pieces after some rounds of EM over all distinct words of the training rows."""
    log_p = Pieces(pieces_path).log_p
    context = vocab.sparkSession.sparkContext
    for _ in range(rounds):
        now = context.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces, sums = Pieces(pieces_path), np.zeros(len(now.value))
            for batch in batches:
                c = batch.column("c").to_numpy()
                for lattice, a, b in lattices(pieces, batch.column("word")):
                    sums += lattice.expected(now.value, c[a:b])
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["piece", "n"])

        seen = vocab.filter("c > 0").select("word", F.lit(1).alias("c")).mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(log_p), PRIOR)
        n[seen["piece"].to_numpy(np.int64)] += seen["n"].to_numpy(float)
        log_p = np.log(n / n.sum())
    return log_p


def score_words(vocab: DataFrame, pieces_path: str, log_p, tokens: int, distinct: int, discount: float) -> DataFrame:
    """h, c, lp: the log10 marginal probability of every word, over the whole-word edge and all segmentations."""
    shared = np.log10(discount * distinct / tokens) if tokens and distinct else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(pieces_path)
        for batch in batches:
            lp = np.empty(batch.num_rows)
            for lattice, a, b in lattices(pieces, batch.column("word")):
                lp[a:b] = lattice.forward(log_p.value)[1] / _LOG10 + shared
            if tokens:
                whole = np.log10(np.maximum(batch.column("c").to_numpy() - discount, 1e-300) / tokens)
                lp = np.logaddexp(lp * _LOG10, whole * _LOG10) / _LOG10
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(lp)], names=["h", "c", "lp"])

    return vocab.mapInArrow(run, "h long, c long, lp double")


def frequent_words(words: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count above which at most ``most`` words lie, and those words' h, c and lp, sorted by h."""
    sizes = words.groupBy(F.floor(F.log2(F.col("c") + 1) * 4).alias("b")).count().toPandas().sort_values("b", ascending=False)  # some 250 rows at most
    least, total = float("inf"), 0
    for b, n in zip(sizes["b"], sizes["count"]):
        total += n
        if total > most:
            break
        least = b
    got = words.filter(F.floor(F.log2(F.col("c") + 1) * 4) >= (least if least != float("inf") else 1 << 30)).toPandas()
    order = np.argsort(h := got["h"].to_numpy(np.int64).view(np.uint64))
    return least, h[order], got["c"].to_numpy(np.int64)[order], got["lp"].to_numpy(float)[order]


def score(docs: DataFrame, train_row, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, train (whether it was learnt from), n_tokens, n_known, train_tokens, base_score, score.

    ``train_row``: a Boolean column expression over ``docs`` (null: not learnt
    from).  A null or empty text is one end.  Without training rows every
    token is unknown: N and V are 0 and the base score is 0.  Rows that repeat
    an id are scored each for itself; other columns are not read.  A very long
    text is a slice of its own in a task; all its words count.
    """
    spark, key = docs.sparkSession, new_key()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train_row, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    vocab = materialize(vocabulary(docs, key))
    known = vocab.filter("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = docs.filter("train").count()
    n, v = known["n"] + ends, known["v"] + (ends > 0)
    discount = min(0.9, max(0.1, known["once"] / max(1, known["once"] + 2 * known["twice"])))
    log_p = train(vocab, pieces_path)
    words = materialize(score_words(vocab, pieces_path, spark.sparkContext.broadcast(log_p), n, known["v"], discount))
    discard(vocab)
    least, h, c, lp = frequent_words(words, frequent)
    table = spark.sparkContext.broadcast((h, c, lp))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end_base, end_score = np.log10((ends + 1) / (n + v + 1)), np.log10(max(ends, 0.5) / max(n, 1))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fh, fc, fl = table.value
        base = np.log10((fc + 1) / (n + v + 1))
        for batch in rows_of(batches, "text", 4 << 20):
            w = Words(batch.column("text"), SPACED)
            m = batch.num_rows
            got, which, size = np.unique(w.hashes(key), return_inverse=True, return_counts=True)
            at = np.minimum(np.searchsorted(fh, got), max(len(fh) - 1, 0))
            hit = fh[at] == got if len(fh) else np.zeros(len(got), bool)
            row = w.row_of()
            sums = [np.bincount(row, np.where(hit, x[at], 0.0)[which], m) if len(fh) and len(w) else np.zeros(m) for x in ((fc > 0).astype(float), base, fl)]
            rare = ~hit[which]
            pairs, tf = np.unique(np.stack([row[rare].astype(np.uint64), got[which[rare]]]), axis=1, return_counts=True) if rare.any() else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            cut = np.searchsorted(pairs[0], np.arange(m + 1).astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[1]).view(np.int64)), pa.array(tf)], ["h", "tf"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("train"), pa.array(w.counts + 1), pa.array(sums[0].astype(np.int64) + (ends > 0)), pa.array(sums[1] + end_base), pa.array(sums[2] + end_score), lists],
                names=["doc_id", "train", "n_tokens", "known", "base", "lp", "rare"],
            )

    scanned = docs.mapInArrow(look_up, f"doc_id {kind}, train boolean, n_tokens long, known long, base double, lp double, rare array<struct<h:long,tf:long>>")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()))
    others = words.filter(F.floor(F.log2(F.col("c") + 1) * 4) < (least if least != float("inf") else 1 << 30))
    rest = scanned.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.tf").join(others, "h").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base2"),
        F.sum(F.col("tf") * F.col("lp")).alias("lp2"),
    )
    return scanned.drop("rare").join(rest, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), (F.col("lp") + F.coalesce("lp2", F.lit(0.0))).alias("score"),
    )
