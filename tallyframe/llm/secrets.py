"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The patterns' matches are always reported.  The field labels tokens as secret
begin, inside or outside from the token's shape, the neighbouring words (by hash) and signs
and what kind of file it stands in.  It is trained by full gradients, one
Spark job each, on a bounded sample of documents in which the patterns' own
matches are the labels, and decoded by Viterbi; what it finds apart from the
patterns' matches is added.  Each stretch of the sample with an assignment is
also taught as prose would have it: key word, one more word, no sign, then the
secret.  That is what the patterns cannot see.  Stretches where a long token
with digits follows a key word and matches no pattern are not taught.

Decoding is exact but skips most tokens: a token's best possible gain over
"outside" is bounded, and only stretches that can have a positive sum of
bounds from both ends can hold a secret.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize
from .tokens import LOWER, Words, rows_of

KINDS = ("assign", "access", "hex", "field")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

#: How many distinct texts the field is trained on at most, in pieces of PIECE tokens, and for how many rounds.
SAMPLE, PIECE, ROUNDS = 4000, 128, 24
#: About how many of these pieces it sees in a round at most.
MOST_PIECES = 60_000

#: Pieces that a worker works through at once.
BLOCK = 500

B, I, O = 0, 1, 2
_LEAST = 1e-300
KEYWORDS = (b"password", b"passwd", b"pwd", b"secret", b"token", b"key", b"apikey", b"api_key", b"api-key", b"bearer", b"authorization", b"credential", b"credentials", b"private_key", b"access_key", b"secret_key")

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-", *range(128, 256)]] = True
_CLASSES = np.zeros((8, 256), np.int32)
_CLASSES[0, 97:123] = _CLASSES[1, 65:91] = _CLASSES[2, 48:58] = _CLASSES[4, 128:] = 1
_CLASSES[3, list(b"+/_.-")] = 1
_CLASSES[5, [*range(48, 58), *range(97, 103)]] = 1
_CLASSES[6, list(b"=:")] = 1
_CLASSES[7, list(b"\"'")] = 1
_CODE = np.zeros(256, np.int32)
_CODE[list(b"={}();<>")] = 1
_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 64])
#: Sizes of the feature groups: shape, word before with signs between, shape before, shape after, shape in its kind of file; the words two before, before and after, by hash.
SIZES = (8 * 32 * 4 * 2, 12, 16, 16, 64, 1024, 1024, 1024)
N_FEATURES, GROUPS = sum(SIZES), len(SIZES)
_AT = np.concatenate(([0], np.cumsum(SIZES)[:-1]))


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """The patterns' matches: (kind, start, end) in bytes, leftmost and without overlap in each kind."""
    out = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_CHARS] if b"AKIA" in raw else []
    return out + [(2, m.start(), m.end()) for m in _HEX.finditer(raw)]


class Tokens:
    """Tokens of some texts with their features."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, _TOKEN, lower=False)
        data, n = w.data, len(w)
        low = Words.__new__(Words)
        low.data, low.start, low.end = LOWER[data], w.start, w.end
        own = low.hashes()
        keys = np.isin(own, _keyword_hashes())
        # A word's bucket; the first is for a missing neighbour.
        word = (own % np.uint64(1023)).astype(np.int32) + 1
        sums = [np.concatenate(([0], np.cumsum(c[data], dtype=np.int32))) for c in _CLASSES]
        of = lambda c, a, b: sums[c][b] - sums[c][a]
        length = w.end - w.start
        bucket = np.searchsorted(_LENGTHS, length, "right")
        digits = of(2, w.start, w.end)
        mask = sum((of(c, w.start, w.end) > 0).astype(np.int64) << c for c in range(5))
        part = np.minimum(digits * 4 // np.maximum(length, 1), 3)
        part[(digits > 0) & (part == 0)] = 1
        shape = ((bucket * 32 + mask) * 4 + part) * 2 + (of(5, w.start, w.end) == length)
        coarse = bucket * 2 + (digits > 0)
        row = w.row_of()
        first = np.zeros(n, bool)
        first[w.first[:-1][w.counts > 0]] = True
        behind = np.where(first, w.start, np.concatenate(([0], w.end[:-1]))) if n else w.start
        between = (of(6, behind, w.start) > 0) + 2 * (of(7, behind, w.start) > 0)
        one = np.concatenate(([False], keys[:-1])) & ~first
        two = np.concatenate(([False], (one & True)[:-1])) & ~first
        before = np.where(one, 1, np.where(two, 2, 0))
        left = np.where(first, 0, np.concatenate(([0], coarse[:-1])))
        last = np.append(first[1:], True) if n else first
        right = np.where(last, 0, np.append(coarse[1:], 0))
        code = np.concatenate(([0], np.cumsum(_CODE[data], dtype=np.int64)))
        size = np.diff(w.rows)
        share = (code[w.rows[1:]] - code[w.rows[:-1]]) * 1000 // np.maximum(size, 1)
        kind = np.searchsorted([1, 5, 20], share, "right")
        self.features = np.zeros((n, GROUPS), np.int32)
        if n:
            past = np.where(first, 0, np.concatenate(([0], word[:-1])))
            past2 = np.where(first, 0, np.concatenate(([0], past[:-1])))
            future = np.where(last, 0, np.append(word[1:], 0))
            for k, values in enumerate((shape, before * 4 + between, left, right, coarse * 4 + kind[row], past2, past, future)):
                self.features[:, k] = values + _AT[k]
        self.row = row

    def labels(self, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
        """Begin, inside, outside by pattern matches; of an assignment only what is assigned."""
        w, out = self.words, np.full(len(self.words), O, np.int8)
        for r, found in enumerate(spans):
            for _, a, b in found:
                i, j = np.searchsorted(w.end, w.rows[r] + a, "right"), np.searchsorted(w.start, w.rows[r] + b)
                while i < j - 1 and LOWER[w.data[w.start[i] : w.end[i]]].tobytes() in KEYWORDS:
                    i += 1
                out[i : i + 1] = B
                out[i + 1 : j] = I
        return out


def _keyword_hashes() -> np.ndarray:
    return np.unique(Words(pa.array([k.decode() for k in KEYWORDS]), np.ones(256, bool), lower=False).hashes())


def _pieces(docs: DataFrame) -> DataFrame:
    """features, labels: the sample's tokens in pieces of at most PIECE, those with assignments also as prose would have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            t = Tokens(batch.column("text"))
            y = t.labels([base_spans(x) for x in raw])
            cuts = [c for a, b in zip(t.words.first, t.words.first[1:]) for c in range(a, b, PIECE)] + [len(y)]
            cuts = sorted(set(cuts))
            pieces = [(t.features[a:b], y[a:b]) for a, b in zip(cuts, cuts[1:]) if not in_doubt(t.features[a:b], y[a:b])]
            pieces += [(as_prose(f, labels), labels) for f, labels in pieces if ((labels == B) & (f[:, 1] >= _AT[1] + 4)).any()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k].tobytes() for x in pieces], pa.binary()) for k in (0, 1)], names=["features", "labels"])

    return docs.select("text").mapInArrow(run, "features binary, labels binary")


def in_doubt(features: np.ndarray, labels: np.ndarray) -> bool:
    """Whether a long token with digits after a key word matches no pattern: as likely a secret as not, so its piece teaches neither."""
    coarse = (features[:, 4] - _AT[4]) // 4
    return bool(((labels == O) & (features[:, 1] >= _AT[1] + 4) & (coarse >= 6) & (coarse % 2 == 1)).any())


def as_prose(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The features if each secret after a key word stood one word further on, without signs; the word between is a short one that nothing is known of."""
    out = features.copy()
    moved = (labels == B) & (features[:, 1] >= _AT[1] + 4)
    out[moved, 5] = features[moved, 6] - _AT[6] + _AT[5]
    out[moved, 6] = _AT[6]
    out[moved, 2] = _AT[2]
    out[moved, 1] = _AT[1] + 8
    return out


def token_scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each token's score for each label, summed feature by feature."""
    out = weights[features[:, 0]]
    for k in range(1, GROUPS):
        out += weights[features[:, k]]
    return out


def gradient(features: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of some pieces: of the feature weights, and of the label-to-label weights."""
    n, size = len(features), max(len(f) for f in features)
    f = np.full((n, size, GROUPS), -1, np.int64)
    y = np.full((n, size), -1, np.int64)
    for i, (a, b) in enumerate(zip(features, labels)):
        f[i, : len(a)], y[i, : len(b)] = a, b
    live = y >= 0
    score = np.zeros((n, size, 3))
    for k in range(GROUPS):
        score += weights[np.maximum(f[:, :, k], 0)]
    # Chances instead of logarithms, scaled at every token; a token's greatest score and the steps' one cancel out.
    near = np.where(live[..., None], np.exp(score - score.max(2, keepdims=True)), 0.0)
    move = np.exp(steps - steps.max())
    ahead, after = np.zeros((size, n, 3)), np.ones((size, n, 3)) / 3.0
    ahead[0] = near[:, 0] / near[:, 0].sum(1, keepdims=True)
    pair, on = np.zeros((3, 3)), live.T[..., None]
    for t in range(1, size):
        now = (ahead[t - 1] @ move) * near[:, t]
        ahead[t] = np.where(on[t], now / np.maximum(now.sum(1, keepdims=True), _LEAST), ahead[t - 1])
    for t in range(size - 2, -1, -1):
        now = (near[:, t + 1] * after[t + 1]) @ move.T
        after[t] = np.where(on[t + 1], now / np.maximum(now.sum(1, keepdims=True), _LEAST), after[t])
    for t in range(1, size):
        way = near[:, t] * after[t]
        each = ((ahead[t - 1] @ move) * way).sum(1)
        pair -= move * (ahead[t - 1].T @ (way / np.maximum(each, _LEAST)[:, None]))
        np.add.at(pair, (y[live[:, t], t - 1], y[live[:, t], t]), 1.0)
    node = ahead * after
    node = (node / np.maximum(node.sum(2, keepdims=True), _LEAST)).transpose(1, 0, 2)
    out, flat, at = np.zeros_like(weights), f[live], y[live]
    rest = -node[live]
    rest[np.arange(len(at)), at] += 1.0
    for c in range(3):
        for k in range(GROUPS):
            out[:, c] += np.bincount(flat[:, k], rest[:, c], len(weights))
    return out, pair


def train(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, most: int = MOST_PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and label-to-label weights, from ``sample`` distinct texts and some ``most`` of their pieces, both picked by hash."""
    hashed = docs.filter("text IS NOT NULL").select(F.xxhash64(F.lit(3), "text").alias("h"), "text")
    least = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.filter(F.col("h") <= F.lit(least)).groupBy("h").agg(F.any_value("text").alias("text"))  # copies meet in their tasks first
    pieces = materialize(_pieces(chosen).repartition(-(-sample // 250)))  # a file may hold most of the sample, and tasks need not follow the corpus
    share = most / max(1, pieces.count())
    if share < 1:
        pieces = pieces.filter(F.pmod(F.xxhash64(F.lit(5), "features"), F.lit(1_000_003)) < int(share * 1_000_003))
    weights, steps = np.zeros((N_FEATURES, 3)), np.array([[-1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, -4.0, 0.0]])
    weights[_AT[1] : _AT[1] + SIZES[1], O] = 4.0
    seen_w, seen_s = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    context = docs.sparkSession.sparkContext
    for _ in range(rounds):
        now = context.broadcast((weights, steps))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            w, s = now.value
            total, pair = np.zeros_like(w), np.zeros_like(s)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    f = [np.frombuffer(x, np.int32).reshape(-1, GROUPS) for x in part.column("features").to_pylist()]
                    y = [np.frombuffer(x, np.int8) for x in part.column("labels").to_pylist()]
                    keep = [i for i, a in enumerate(f) if len(a)]
                    if keep:
                        g, p = gradient([f[i] for i in keep], [y[i] for i in keep], w, s)
                        total += g
                        pair += p
            flat = np.concatenate((total.ravel(), pair.ravel()))
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["i", "g"])

        got = pieces.mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()  # at most one row per weight
        flat = np.zeros(weights.size + steps.size)
        flat[got["i"].to_numpy(np.int64)] = got["g"].to_numpy(float)
        g, p = flat[: weights.size].reshape(weights.shape) - 0.01 * weights, flat[weights.size :].reshape(steps.shape)
        g[_AT[5:]] = 0.0  # a missing or unknown neighbour tells nothing
        seen_w += g**2
        seen_s += p**2
        weights, steps = weights + g / np.sqrt(seen_w), steps + 0.5 * p / np.sqrt(seen_s)
        now.unpersist()
    return weights, steps


def decode(score: np.ndarray, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Viterbi labels of all tokens; ``first``: the texts' offsets."""
    out = np.full(len(score), O, np.int8)
    if not len(score):
        return out
    # What a token can gain at most over being outside, whatever its neighbours.
    swing = max(0.0, float((steps - steps[O, O]).max())) * 2
    gain = np.maximum(score[:, B], score[:, I]) - score[:, O] + swing
    cut = np.zeros(len(score) + 1)
    cut[first] = 1e9  # nothing crosses from text to text
    ahead = np.cumsum(np.where(cut[:-1] > 0, -1e7, 0.0) + gain)
    behind = np.cumsum((np.where(cut[1:] > 0, -1e7, 0.0) + gain)[::-1])
    rises = ahead - np.minimum.accumulate(np.where(cut[:-1] > 0, ahead - gain, np.concatenate(([0.0], ahead[:-1])))) > 0
    falls = (behind - np.minimum.accumulate(np.where(cut[1:][::-1] > 0, behind - gain[::-1], np.concatenate(([0.0], behind[:-1])))) > 0)[::-1]
    live = rises & falls
    if not live.any():
        return out
    head = live & ~np.concatenate(([False], live[:-1])) | live & (cut[:-1] > 0)
    at = np.flatnonzero(head)
    tail = live & ~np.append(live[1:], False) | live & (cut[1:] > 0)
    end = np.flatnonzero(tail) + 1
    opening = cut[at] > 0  # a stretch at a text's start has no token before it
    order = np.argsort(at - end, kind="stable")  # the longest first
    at, end, opening = at[order], end[order], opening[order]
    size = end - at
    closing = cut[end] > 0
    best = np.where(opening[:, None], 0.0, steps[O]) + score[at]
    back = []
    for t in range(1, size[0]):
        m = int(np.searchsorted(-size, -t, "left"))
        way = best[:m, :, None] + steps
        back.append(way.argmax(1))
        best[:m] = way.max(1) + score[at[:m] + t]
    label = np.where(closing[:, None], best, best + steps[:, O]).argmax(1)
    for t in range(size[0] - 1, -1, -1):
        m = int(np.searchsorted(-size, -t, "left"))
        out[at[:m] + t] = label[:m]
        if t:
            label[:m] = np.take_along_axis(back[t - 1], label[:m, None], 1)[:, 0]
    return out


def code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """How many code points stand before each of some byte offsets; the text is counted through once."""
    out, at, n = {}, 0, 0
    plain = raw.isascii()
    for p in sorted(set(places)):
        n, at = p if plain else n + len(raw[at:p].decode()), p
        out[p] = n
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, found: array of (kind, start, end), in code points, by start, then kind.

    Kinds are assign, access, hex (the patterns; the span is the whole match)
    and field (what the conditional random field adds; it never overlaps a
    pattern's match).  Null and empty texts have no spans; a corpus without
    any match trains a field that finds nothing.  Long texts are scanned whole, in
    time linear in their length but for the sorting of spans; of labellings that
    tie, Viterbi keeps the one whose label comes first in begin, inside, outside.  Rows repeating an id, null
    ids included, are scanned each for itself; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample, rounds))
    kind = docs.schema["id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, steps = model.value
        for batch in rows_of(batches, "text"):
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            spans = [base_spans(x) for x in raw]
            edges = [(sorted(a for _, a, _ in own), sorted(b for _, _, b in own)) for own in spans]
            t = Tokens(batch.column("text"))
            w = t.words
            label = decode(token_scores(t.features, weights), steps, w.first)
            hit = np.flatnonzero(label != O)
            i = 0
            while i < len(hit):
                j = i + 1
                while j < len(hit) and hit[j] == hit[j - 1] + 1 and label[hit[j]] == I and t.row[hit[j]] == t.row[hit[i]]:
                    j += 1
                r = t.row[hit[i]]
                a, b = int(w.start[hit[i]] - w.rows[r]), int(w.end[hit[j - 1]] - w.rows[r])
                if bisect_left(edges[r][0], b) == bisect_right(edges[r][1], a):  # all that begin before it ends have ended
                    spans[r].append((3, a, b))
                i = j
            found = []
            for x, own in zip(raw, spans):
                chars = code_points(x, [p for _, a, b in own for p in (a, b)])
                found.append([{"kind": KINDS[k], "start": chars[a], "end": chars[b]} for a, k, b in sorted((a, k, b) for k, a, b in own)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(item))], names=["id", "found"])

    return docs.mapInArrow(run, f"id {kind}, found array<struct<kind:string,start:long,end:long>>")


def spans_text(found, base_only: bool):
    """kind:start:end of the spans, comma-joined."""
    kept = F.filter(found, lambda s: s["kind"] != "field") if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(found, kind: str):
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
