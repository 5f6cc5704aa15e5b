"""Hard negatives by segment summaries: bounds from means and deviations rule rows out before exact products.

Every vector is cut into segments, and each segment's mean and deviation are
taken, for two lengths of segments.  The product of two segments of length l
lies within l * (product of means +- product of deviations), so sums over
segments bound a pair's score from both sides, and halving the segments
tightens the bounds.  Rows lie in blocks and anchors in chunks; a task meets a
chunk with a share of the blocks, one block after the other, and keeps the
best few of each anchor so far.  Rows that the bounds rule out for all anchors
of a slice, given those, are dropped; the rest is multiplied exactly.  The
coarse bounds are two small matrix products, the fine ones as large as the
exact product, so a few anchors of a slice try the bounds first, and where
most rows would be left, the slice goes on without them for some blocks.

Thresholds come from the best few so far (so the first block is multiplied
without bounds) and, for negatives, from the positives' scores.  A task passes on its best few rows
an anchor, so what is shuffled is counts of anchors and shares, never pairs or
blocks' best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import bound_batches, materialize

POSITIVES, NEGATIVES = 5, 10
#: Per cent of the positive's score that a negative's must reach and may not exceed.
LEAST, MOST = 30, 90
#: Lengths of segments, coarse and fine; vectors are padded with zeros to a multiple of the coarse one.
SEGMENTS = (8, 2)
#: Rows of a block, anchors of a chunk (a block is shuffled once a chunk), anchors that are bounded and multiplied at once, with so many rows.
BLOCK, CHUNK, SLICE, TILE = 8192, 32768, 256, 2048
#: One anchor of so many tries the bounds; they are used where they leave less than this share of the rows.
TRIED, LEFT = 16, 0.5
#: Whole numbers up to these are exact in single and in double precision.
EXACT = (1 << 24, 1 << 53)
#: Candidates an anchor of a tile from which thresholds are taken from the tile itself; chunks whose best few a task holds at once.
MANY, HELD = 64, 4
#: The score of a place that no row has taken, below all others, and what no score reaches.
NONE, BEYOND = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PACKED = "dim int, n int, width int, ids binary, labels binary, q binary"


def rows_of_vectors(vectors: DataFrame, scale: float, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """id, label, q (whole numbers: floor of ``scale`` times each component) of the vectors that take part.

    Left out: a null id, label or vector, vectors without components or with a
    null or non-finite one, and, as their products would not fit 64 bits, those
    with a component of the square root of 2^63 over the dimension or more.
    """
    q = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fits = F.forall(vec_col, lambda x: F.abs(x.cast("double") * scale) < F.sqrt(F.lit(2.0**63) / F.size(vec_col)) - 2)
    use = F.col(id_col).isNotNull() & F.col("__label").isNotNull() & F.coalesce(F.size(vec_col) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False))
    return vectors.withColumn("__label", label.cast("long")).filter(use).filter(fits).select(F.col(id_col).cast("long").alias("id"), F.col("__label").alias("label"), q.alias("q"))


def _summaries(q: np.ndarray) -> np.ndarray:
    """For every length of segments the means, then the deviations, each times the square root of the length."""
    x = np.pad(q.astype(np.float64), ((0, 0), (0, -q.shape[1] % SEGMENTS[0])))
    out = []
    for width in SEGMENTS:
        parts = x.reshape(len(x), -1, width)
        out += [parts.mean(2) * width**0.5, parts.std(2) * width**0.5]
    return np.concatenate(out, axis=1)


class Block:
    """Rows of one dimension, by label, then id."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.stored = np.frombuffer(row["q"], f"<i{row['width']}").reshape(row["n"], self.dim)
        self._of = None

    @cached_property
    def q(self) -> np.ndarray:
        return self.stored.astype(np.int64)

    @cached_property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.stored.astype(np.float64) ** 2).sum(1))

    @cached_property
    def longest(self) -> float:
        return self.norm.max(initial=0)

    @cached_property
    def single(self) -> np.ndarray:
        return self.stored.astype(np.float32)

    @cached_property
    def double(self) -> np.ndarray:
        return self.stored.astype(np.float64)

    @cached_property
    def parts(self) -> list[tuple[int, Block]]:
        """Slices, as anchors."""
        return list(self.slices())

    @cached_property
    def tiles(self) -> list[Block]:
        """Slices, as rows."""
        return [tile for _, tile in self.slices(TILE)]

    @cached_property
    def repeats(self) -> int:
        """How many rows share an id at most."""
        return int(np.unique(self.ids, return_counts=True)[1].max(initial=1))

    @cached_property
    def level(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every length of segments (means, deviations)."""
        if self._of:
            whole, some = self._of
            return [(m[some], d[some]) for m, d in whole.level]
        sums, out, at = _summaries(self.q), [], 0
        for width in SEGMENTS:
            k = (self.dim + -self.dim % SEGMENTS[0]) // width
            out.append((sums[:, at : at + k], sums[:, at + k : at + 2 * k]))
            at += 2 * k
        return out

    def take(self, some: slice | np.ndarray) -> Block:
        """Some of the rows."""
        part = Block.__new__(Block)
        part.dim, part.ids, part.labels, part.stored, part._of = self.dim, self.ids[some], self.labels[some], self.stored[some], (self, some)
        return part

    def slices(self, most: int = SLICE) -> Iterator[tuple[int, Block]]:
        """The first row's number and the rows, ``most`` at a time."""
        for at in range(0, len(self.ids), most):
            yield at, self.take(slice(at, at + most))

    def run(self, label: int) -> slice:
        """Where the rows of a label lie."""
        return slice(*(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right")))


def _packed(ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> dict:
    order = np.lexsort((ids, labels))
    most = int(np.abs(q).max(initial=0))
    width = next(w for w in (2, 4, 8) if w == 8 or most < 1 << (8 * w - 1))
    return {"dim": q.shape[1], "n": len(q), "width": width, "ids": ids[order].astype("<i8").tobytes(), "labels": labels[order].astype("<i8").tobytes(), "q": q[order].astype(f"<i{width}").tobytes()}


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows (id, label, q) of a task in packed blocks, each of one dimension."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def emit(dim: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([_packed(*(np.concatenate(x) for x in zip(*held.pop(dim))))], schema=_SCHEMA)

    for batch in batches:
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        q = batch.column("q")
        size = q.value_lengths().to_numpy()
        flat, at = q.flatten().to_numpy(), np.cumsum(size) - size
        for dim in np.unique(size).tolist():
            mine = np.flatnonzero(size == dim)
            for some in np.array_split(mine, -(-len(mine) // most)):
                held.setdefault(dim, []).append((ids[some], labels[some], flat[at[some][:, None] + np.arange(dim)]))
                if sum(len(x[0]) for x in held[dim]) >= most:
                    yield emit(dim)
    for dim in list(held):
        yield emit(dim)


_SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary())])


def _bounds(anchors: Block, rows: Block, level: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all anchors with the rows ``mine``, wide enough for rounding."""
    (m1, d1), (m2, d2) = anchors.level[level], rows.level[level]
    means, spread = m1 @ m2[mine].T, d1 @ d2[mine].T
    spread += 1e-9 * np.outer(anchors.norm, rows.norm[mine]) + 1e-3
    return means - spread, means + spread


def _products(anchors: Block, rows: Block) -> np.ndarray:
    """Exact scores of all anchors with all rows, whole numbers in the cheapest type that holds them."""
    most = anchors.longest * rows.longest  # no partial sum exceeds it
    if most < EXACT[0] / 2:
        return anchors.single @ rows.single.T
    return anchors.double @ rows.double.T if most < EXACT[1] / 2 else anchors.q @ rows.q.T


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer columns."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _possible(anchors: Block, rows: Block, allowed, narrow) -> tuple[np.ndarray, np.ndarray]:
    """Rows left for some anchor after both levels of bounds, and which (anchor, row) pairs are still possible.

    ``allowed``: pairs that the labels and ids let in, for given rows.
    ``narrow``: of those, the ones that the bounds leave.
    """
    mine = np.arange(len(rows.ids))
    live = allowed(mine)
    for level in range(len(SEGMENTS)):
        keep = live.any(0)
        mine, live = mine[keep], live[:, keep]
        if not len(mine):
            break
        low, high = _bounds(anchors, rows, level, mine)
        live &= narrow(live, low, high)
    keep = live.any(0)
    return mine[keep], live[:, keep]


def _left(anchors: Block, rows: Block, narrow: Callable, allowed: Callable) -> Block | None:
    """The rows that the bounds leave for some anchor; none where a few anchors show that most would be left."""
    mine = np.arange(len(rows.ids))
    for who in (np.arange(0, len(anchors.ids), TRIED), np.arange(len(anchors.ids))):
        mine, _ = _possible(anchors.take(who), rows, lambda m: allowed(who, m), lambda *a: narrow(who, *a))  # noqa: B023
        if len(mine) > LEFT * len(rows.ids):
            return None
    return rows.take(mine)


def _order(lists: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Places by list, then score, the largest first, then id; by one key where list and score fit it, ties of it apart."""
    top, span = int(score.max()), int(score.max()) - int(score.min()) + 1
    if span * (int(lists.max()) + 1) >= 1 << 62:
        return np.lexsort((id_, ~score, lists))
    key = lists * span + (top - score)
    order = np.argsort(key)
    tied = np.diff(key[order]) == 0
    if tied.any():
        at = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        some = order[at]
        order[at] = some[np.lexsort((id_[some], key[some]))]
    return order


class Best:
    """The first ``k`` (score, id) of some lists so far, the larger score first, then the smaller id, each once."""

    def __init__(self, lists: int, k: int):
        self.score, self.id = np.full((lists, k), NONE), np.zeros((lists, k), np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(lists):
            return
        old = np.unique(lists)
        row, col = np.nonzero(self.score[old] != NONE)
        lists, score, id_ = np.concatenate((old[row], lists)), np.concatenate((self.score[old][row, col], score)), np.concatenate((self.id[old][row, col], id_))
        order = _order(lists, score, id_)
        lists, score, id_ = lists[order], score[order], id_[order]
        new = np.append(True, (lists[1:] != lists[:-1]) | (score[1:] != score[:-1]) | (id_[1:] != id_[:-1]))
        lists, score, id_ = lists[new], score[new], id_[new]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        first = place < self.score.shape[1]
        self.score[lists[first], place[first]], self.id[lists[first], place[first]] = score[first], id_[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """list, score, id"""
        lists, place = np.nonzero(self.score != NONE)
        return lists, self.score[lists, place], self.id[lists, place]


def _places(hit: np.ndarray) -> np.ndarray:
    """Where a flattened array is true; few places are found eight entries at a time."""
    flat = hit.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    which, at = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[which] * 8 + at


def _kth_whole(ordered: np.ndarray, k: int, among: np.ndarray | None = None) -> np.ndarray:
    """The k-th largest of each row of scores as a whole number, NONE where there are fewer; ``among``: of the first so many, which are sorted."""
    if among is None:
        kth = _kth(ordered, k)
    else:
        kth = np.where(among >= k, ordered[np.arange(len(ordered)), np.maximum(among - k, 0)].astype(np.float64 if ordered.dtype.kind == "f" else np.int64), -np.inf if ordered.dtype.kind == "f" else NONE)
    return np.where(kth > NONE, kth, 0).astype(np.int64) + np.where(kth > NONE, 0, NONE)


class Search:
    """The best rows so far of a chunk's anchors; blocks are added one after the other."""

    def __init__(self, anchors: Block, lists: int, k: int):
        self.anchors, self.k, self.best = anchors, k, Best(len(anchors.ids) * lists, k)
        self.wait, self.step = {}, {}

    def bounded(self, at: int, anchors: Block, rows: Block, narrow: Callable, allowed: Callable) -> Block:
        """The rows that the bounds leave, tried from the second block on, and again after twice as many blocks each time that they leave most."""
        if self.wait.setdefault(at, 1):
            self.wait[at] -= 1
            return rows
        left = _left(anchors, rows, narrow, allowed)
        self.step[at] = min(64, 2 * self.step.get(at, 1)) if left is None else 1
        self.wait[at] = self.step[at] - 1
        return rows if left is None else left


class Positives(Search):
    """Rows of an anchor's label with another id."""

    def __init__(self, anchors: Block, k: int):
        super().__init__(anchors, 1, k)
        self.alike = []
        for at, some in anchors.parts:
            for label in np.unique(some.labels).tolist():
                run = some.run(label)
                self.alike.append((at + run.start, label, some.take(run)))

    def add(self, rows: Block) -> None:
        alike = {label: rows.take(rows.run(label)) for label in np.unique(rows.labels).tolist()}
        for at, label, some in self.alike:
            if label in alike:
                self.tiles(at, some, alike[label])

    def tiles(self, at: int, anchors: Block, rows: Block) -> None:
        need = lambda: self.best.score[at : at + len(anchors.ids), -1]
        k = (self.k + 1) * rows.repeats  # of so many entries, k are of different ids other than the anchor's

        def narrow(who: np.ndarray, live: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= need()[who].astype(np.float64)[:, None]

        rows = self.bounded(at, anchors, rows, narrow, lambda who, m: anchors.ids[who][:, None] != rows.ids[m])
        for tile in rows.tiles:
            scores = _products(anchors, tile)
            least = need()
            hit = scores >= least.astype(scores.dtype)[:, None]
            if np.count_nonzero(hit) > MANY * len(least):
                hit = scores >= np.maximum(least, _kth_whole(scores, k)).astype(scores.dtype)[:, None]
            a, r = np.divmod(_places(hit), hit.shape[1])
            other = anchors.ids[a] != tile.ids[r]
            a, r = a[other], r[other]
            self.best.add(at + a, scores[a, r].astype(np.int64), tile.ids[r])


class Negatives(Search):
    """Rows of other labels between the bounds of each positive, which are (anchors, positives) arrays, empty ranges where lowest > highest."""

    def __init__(self, anchors: Block, lowest: np.ndarray, highest: np.ndarray, k: int):
        super().__init__(anchors, lowest.shape[1], k)
        self.lowest, self.highest = np.where(lowest <= highest, lowest, BEYOND), np.where(lowest <= highest, highest, NONE)

    def add(self, rows: Block) -> None:
        for at, some in self.anchors.parts:
            self.tiles(at, some, rows)

    def tiles(self, at: int, anchors: Block, rows: Block) -> None:
        n, lists = len(anchors.ids), self.lowest.shape[1]
        roof, k = self.highest[at : at + n], self.k * rows.repeats
        need = lambda: np.maximum(self.lowest[at : at + n], self.best.score[at * lists : (at + n) * lists, -1].reshape(n, lists))

        def narrow(who: np.ndarray, live: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            least, left = need()[who].astype(np.float64), np.zeros(live.shape, bool)
            for p in range(lists):
                left |= (high >= least[:, p, None]) & (low <= roof[who, p, None].astype(np.float64))
            return left

        rows = self.bounded(at, anchors, rows, narrow, lambda who, m: anchors.labels[who][:, None] != rows.labels[m])
        for tile in rows.tiles:
            scores = _products(anchors, tile)
            kind, never = scores.dtype, -np.inf if scores.dtype.kind == "f" else NONE
            for label in np.unique(anchors.labels).tolist():
                scores[anchors.run(label), tile.run(label)] = never
            least = need()
            hit = scores >= least.min(1).astype(kind)[:, None]
            if np.count_nonzero(hit) > MANY * n:
                hit[:], ordered = False, np.sort(scores, axis=1)
                for p in range(lists):
                    top = scores <= roof[:, p, None].astype(kind)
                    least[:, p] = np.maximum(least[:, p], _kth_whole(ordered, k, np.count_nonzero(top, axis=1)))
                    hit |= top & (scores >= least[:, p, None].astype(kind))
            a, r = np.divmod(_places(hit), hit.shape[1])
            score = scores[a, r].astype(np.int64)
            which, p = np.nonzero((score[:, None] >= least[a]) & (score[:, None] <= roof[a]))
            self.best.add((at + a[which]) * lists + p, score[which], tile.ids[r[which]])


def mine_negatives(
    vectors: DataFrame, anchor: Column, label: Column, scale: float = 256.0, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor over whole numbers; the
    larger comes first, then the smaller id.  An anchor's positives are its
    first other rows (ids) of the same label, a positive's negatives the first
    rows of other labels with least * p <= 100 * n <= most * p.  ``anchor`` and
    ``label`` are over the columns of ``vectors``.

    See :func:`rows_of_vectors` for rows that take no part; vectors of other
    dimensions than the anchor's are not compared with it.  Rows that repeat
    an id with one score count once for an anchor, anchors that repeat id,
    label and vector are one.  Without anchors or positives there are no rows.
    A label that most rows share is spread over blocks like any other.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = rows_of_vectors(vectors.withColumn("__anchor", F.coalesce(anchor, F.lit(False))), scale, id_col, label, vec_col)
    chosen = rows_of_vectors(vectors.filter(F.coalesce(anchor, F.lit(False))), scale, id_col, label, vec_col).distinct()
    blocks = materialize(rows.mapInArrow(lambda it: _blocks(it, block), _PACKED).withColumn("block", F.monotonically_increasing_id()))
    chosen = materialize(chosen.withColumn("dim", F.size("q")))
    parts = {r.dim: -(-r.n // chunk) for r in chosen.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    parts = dict(sorted(parts.items()))
    known = F.create_map(*(F.lit(x) for p in parts.items() for x in p)) if parts else F.create_map().cast("map<int,int>")

    def pack(group: pa.Table) -> pa.Table:
        one = next(_blocks(iter(group.combine_chunks().to_batches()), 1 << 60))
        return pa.Table.from_batches([one]).add_column(0, "chunk", [group.column("chunk").slice(0, 1)])

    dealt = chosen.withColumn("chunk", F.pmod(F.xxhash64("id", "label", "q"), F.element_at(known, F.col("dim"))).cast("int"))
    chunks = materialize(dealt.groupBy("dim", "chunk").applyInArrow(pack, "chunk int, " + _PACKED))
    # Anchors are copied for every share of the blocks, blocks for every chunk, so that pairs of both are dealt evenly.
    # The first blocks of a share cost the most, as nothing is known of the best yet, so there are no more shares than cores need.
    tasks = 2 * spark.sparkContext.defaultParallelism
    shares = max(1, min(-(-tasks // max(1, sum(parts.values()))), blocks.count()))
    spread = blocks.select("*", F.explode(F.sequence(F.lit(0), F.element_at(known, F.col("dim")) - 1)).alias("chunk"), F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share")) if parts else blocks.withColumns({"chunk": F.lit(0), "share": F.lit(0).cast("long")}).limit(0)

    def meet(right: DataFrame, begin: Callable[[dict, Block], Search], schema: str) -> DataFrame:
        """Blocks with the anchors of ``right``; list (a number), score and id of the best of each."""
        copied = right.withColumnsRenamed({c: f"a_{c}" for c in right.columns if c not in ("dim", "chunk")}).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        both = spread.join(copied.hint("merge"), ["dim", "chunk", "share"])  # blocks of a small table would stay in the few tasks that read them

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], Search] = {}

            def emit(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
                search = held.pop(key)
                lists, score, id_ = search.best.rows()
                for at in range(0, len(lists), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    same = [pa.array(np.full(len(lists[some]), x, np.int32)) for x in key]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(lists[some]), pa.array(score[some]), pa.array(id_[some])], names=["dim", "chunk", "list", "score", "id"])

            for batch in batches:
                for i in range(batch.num_rows):
                    value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                    key = value("dim"), value("chunk")
                    if key not in held:
                        row = {c[2:]: value(c) for c in batch.schema.names if c[:2] == "a_"}
                        held[key] = begin(row, Block(row | {"dim": key[0]}))
                    held[key].add(Block({c: value(c) for c in ("dim", "n", "width", "ids", "labels", "q")}))
                    if len(held) > HELD:
                        yield from emit(next(iter(held)))
            for key in list(held):
                yield from emit(key)

        return both.mapInArrow(run, schema)

    listed = "dim int, chunk int, list long, score long, id long"
    best = Window.partitionBy("dim", "chunk", "list").orderBy(F.desc("score"), "id")
    found = meet(chunks, lambda row, anchors: Positives(anchors, positives), listed)
    found = materialize(found.withColumn("p", F.dense_rank().over(best) - 1).filter(F.col("p") < positives).distinct())
    held = found.groupBy("dim", "chunk").agg(F.collect_list(F.struct("list", "p", "score")).alias("found"))  # some for each anchor of a chunk

    def ranges(row: dict, anchors: Block) -> Negatives:
        place, p, score = (np.array([f[c] for f in row["found"]], np.int64) for c in ("list", "p", "score"))
        lowest, highest = np.ones((len(anchors.ids), positives), np.int64), np.zeros((len(anchors.ids), positives), np.int64)
        lowest[place, p] = [-(-least * int(s) // 100) for s in score]
        highest[place, p] = [most * int(s) // 100 for s in score]
        return Negatives(anchors, lowest, highest, negatives)

    out = meet(chunks.join(held, ["dim", "chunk"]), ranges, listed)
    out = out.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= negatives).distinct()
    out = out.select("dim", "chunk", F.expr(f"list div {positives}").alias("place"), (F.col("list") % positives).cast("int").alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    whose = found.select("dim", "chunk", F.col("list").alias("place"), "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = chunks.select("dim", "chunk", "n", "ids").mapInArrow(_named, "dim int, chunk int, place long, anchor_id long")
    return out.join(whose, ["dim", "chunk", "place", "p"]).join(named, ["dim", "chunk", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of chunks' anchors by their places."""
    for batch in batches:
        for row in batch.to_pylist():
            same = [pa.array(np.full(row["n"], row[c], np.int32)) for c in ("dim", "chunk")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(row["n"])), pa.array(np.frombuffer(row["ids"], "<i8"))], names=["dim", "chunk", "place", "anchor_id"])


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
    FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
    SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
