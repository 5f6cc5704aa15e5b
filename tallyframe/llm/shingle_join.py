"""N-gram Jaccard join on an R-tree of count vectors.

Shingles are hashed into groups and a document becomes the point of its group
counts; two documents overlap in no more than the summed minima of their
coordinates.  Every step below is a cut by that bound:

* root.  Coordinates (as fine as the shingle hash) are ordered by the mass that
  their group has over all documents, rarest first.  If two points share none
  of their leading coordinates (all but the last of a document's
  ceil(0.85 n) - 1), what is left of the minima cannot reach the overlap that
  the threshold asks for.  So the tree is one that enters a point in several
  children: a child, called a slab, for each leading coordinate.  A filter of
  fixed size drops slabs of one point before any row is shuffled.
* boxes.  Below a slab points are sorted by class, size and id and packed into
  pages, pages into nodes, nodes into tops, each with its bounding box: the
  greatest count in every group, the least and greatest size.  Spark joins tops
  inside a slab, then the nodes of the pairs left, then their pages, then
  points; at each level the boxes' summed minima rule pairs out.  A slab that
  fits one page is a tree of one page, so its points meet where it is packed.
* points.  Pairs left meet once, in as many groups as their size calls for.

A tree over all points with boxes alone would have to look at nearly all pairs
of pages: documents without common text lie equally far from each other, so
boxes of unrelated points overlap.  The slabs are what keeps the join linear.

Surviving pairs are verified on whole shingle sets, word by word.  Equal sets
are one class from the start.  Before the boxes are joined, points are verified
against one hub of each slab and joined into components, and then again, as
long as that links anything, against a hub from the slab's other components:
in a large group of near copies nearly all points are then known to be
connected, and pairs inside a component are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .copies import mark_copies
from .filters import passes, repeated
from .graph import components
from .session import discard, materialize, partitions, small
from .tokens import SPACED, Words, mix, new_key, rows_of, window_starts, windows

SHINGLE, PERCENT = 4, 85
GROUP_BITS = 19
#: Points in a page, pages in a node, nodes in a top.
PAGE, FAN = 32, 16
#: Groups of the boxes.
COARSE = 64
#: Rounds of hubs at most; more of them would only shorten the work that follows.
HUB_ROUNDS = 3
#: Of a point's slabs, so many (the least by name) are carried with it: where two points have one of these in common, they meet in the least of them alone.
NAMED = 8
#: Bytes of text whose shingles are sorted at once in a task.
SLICE = 1 << 20
#: Texts up to which the hashes of those to verify are broadcast.
BROADCAST_ROWS = 500_000
_SIGNS = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class ShingleSets:
    """The distinct shingles of some texts, text after text: ``h``, ``text``, ``first`` (offsets)."""

    def __init__(self, texts: pa.Array, k: int, key: int = 0):
        w = Words(texts, SPACED)
        hashes = w.hashes(key)
        n = len(w.counts)
        at = window_starts(w.counts, w.first, k)
        h, text = [windows(hashes, k, seed=k)[at]], [np.searchsorted(w.first, at, "right") - 1]
        for short in range(1, k):  # a text of fewer words is one shingle
            row = np.flatnonzero(w.counts == short)
            h.append(windows(hashes, short, seed=short)[w.first[row]] if len(row) else np.zeros(0, np.uint64))
            text.append(row)
        h, text = np.concatenate(h), np.concatenate(text)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
        self.h, self.text = h[new], text[new]
        self.first = np.searchsorted(self.text, np.arange(n + 1))
        self.n = np.diff(self.first)

    def signatures(self) -> list[np.ndarray]:
        """Two 64-bit numbers per set, the same for equal sets; 0 for the empty set."""
        out = []
        for sign in _SIGNS:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.h ^ sign), dtype=np.uint64)))
            out.append(np.where(self.n > 0, mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)), np.uint64(0)))
        return out

    def leading(self, mass: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The leading coordinates of every text, and their texts."""
        order = np.lexsort((self.h, mass[self.h >> np.uint64(64 - GROUP_BITS)], self.text))
        h, text = self.h[order], self.text[order]
        rank = np.arange(len(h)) - self.first[text]
        most = self.n - (percent * self.n + 99) // 100 + 1
        keep = rank < most[text]
        return h[keep], text[keep]

    def counts(self, i: int) -> bytes:
        """A text's group counts, in about as many groups as it has shingles; see :func:`vector`."""
        bits = group_bits(int(self.n[i]))
        h = self.h[self.first[i] : self.first[i + 1]]
        c = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes()


def group_bits(n: int) -> int:
    return min(12, max(6, n.bit_length() - 1))


def vector(raw: bytes, n: int) -> np.ndarray:
    """The counts of a set of ``n``: one byte each where that is enough, else four."""
    return np.frombuffer(raw, np.uint8 if len(raw) == 1 << group_bits(n) else np.uint32).astype(np.int64)


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors brought to the fewest groups among them, by adding neighbours up."""
    least = min(len(v) for v in vectors)
    return np.stack([v.reshape(least, -1).sum(1) for v in vectors])


def need(n1, n2, percent: int):
    """The least overlap of sets of these sizes at the threshold."""
    return -(-percent * (n1 + n2) // (100 + percent))


def sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return (n1 * percent <= n2 * 100) & (n2 * percent <= n1 * 100)


def group_mass(texts: DataFrame, k: int, key: int) -> np.ndarray:
    """How many distinct shingles of all texts fall into each of 2**GROUP_BITS groups."""
    blocks = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(1 << GROUP_BITS, np.int64)
        for batch in rows_of(batches, "text", SLICE):
            w = Words(batch.column("text"), SPACED)
            h = windows(w.hashes(key), k, seed=k)[window_starts(w.counts, w.first, k)]
            mass += np.bincount((h >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=len(mass))
        if mass.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks)), pa.array([b.tobytes() for b in mass.reshape(blocks, -1)])], names=["block", "mass"])

    def add(key: tuple, got: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in got.column("mass").combine_chunks())
        return pa.table({"block": [key[0].as_py()], "mass": [total.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("mass", pa.binary())]))

    rows = texts.mapInArrow(run, "block long, mass binary").groupBy("block").applyInArrow(add, "block long, mass binary").toPandas().sort_values("block")
    return np.concatenate([np.frombuffer(bytes(b), np.int64) for b in rows["mass"]]) if len(rows) else np.zeros(1 << GROUP_BITS, np.int64)


def _points(texts: DataFrame, mass, flags, k: int, percent: int, key: int) -> DataFrame:
    """t1, t2, g1, g2 (class), n, slabs, counts: one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", SLICE):
            s = ShingleSets(batch.column("text"), k, key)
            h, text = s.leading(mass.value, percent)
            hit = passes(flags.value, h)
            h, text = h[hit], text[hit]
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            used = cut[1:] > cut[:-1]
            counts = [s.counts(i) if u else None for i, u in enumerate(used)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1"), batch.column("t2"), *(pa.array(g.view(np.int64)) for g in s.signatures()), pa.array(s.n), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64))), pa.array(counts, pa.binary())],
                names=["t1", "t2", "g1", "g2", "n", "slabs", "counts"],
            )

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, g1 long, g2 long, n long, slabs array<long>, counts binary")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose points' summed minima reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            least = need(n1, n2, percent)
            for i, (x, y) in enumerate(zip(batch.column("c1"), batch.column("c2"))):
                p = folded([vector(x.as_py(), int(n1[i])), vector(y.as_py(), int(n2[i]))])
                if np.minimum(p[0], p[1]).sum() >= least[i]:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    p = points.select("v", "n", "counts")
    joined = pairs.join(p.toDF("a", "n1", "c1"), "a").join(p.toDF("b", "n2", "c2"), "b")
    return joined.filter(sizes_fit(F.col("n1"), F.col("n2"), percent)).select("a", "b", "n1", "n2", "c1", "c2").mapInArrow(run, "a long, b long")


def overlaps(left: pa.Array, right: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that both texts of each pair have, and those of either; words are compared, not hashes.

    Words become their places in a list of distinct words, runs of words the
    places of their pairs, so that equal numbers are equal shingles.
    """
    m = len(left)
    w = Words(pa.chunked_array([left, right]).combine_chunks(), SPACED)
    code, distinct = w.coded()
    span = len(distinct) + 1
    at = window_starts(w.counts, w.first, k)
    short = np.flatnonzero((w.counts < k) & (w.counts > 0))
    at = np.concatenate((at, w.first[short]))
    text = np.searchsorted(w.first, at, "right") - 1
    run = np.zeros(len(at), np.int64)
    for j in range(k):  # beyond the end of a short text stands a word of its own
        inside = at + j < w.first[text + 1]
        word = np.where(inside, code[np.minimum(at + j, len(code) - 1)], span - 1) if len(code) else run
        run = run * span + word
        if j + 1 < k and (int(run.max(initial=0)) + 1) * span >= 1 << 62:
            run = np.unique(run, return_inverse=True)[1]
    run = np.unique(run, return_inverse=True)[1]
    pair, side = text % m, text // m
    key = np.unique((pair * (int(run.max(initial=0)) + 1) + run) * 2 + side)
    pair = key // 2 // (int(run.max(initial=0)) + 1)
    both = np.flatnonzero(key[1:] // 2 == key[:-1] // 2)
    n = [np.bincount(pair[key % 2 == s], minlength=m) for s in (0, 1)]
    return np.bincount(pair[both], minlength=m), n[0], n[1]


def _verified(pairs: DataFrame, texts: DataFrame, points: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    wanted = materialize(points.select("v", "t1", "t2").join(wanted, "v", "left_semi"))
    sets = materialize(texts.select("t1", "t2", "text").join(small(wanted, BROADCAST_ROWS), ["t1", "t2"]).select("v", "text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(rows_of(batches, "x", SLICE), "y", SLICE):
            both, n1, n2 = overlaps(batch.column("x"), batch.column("y"), k)
            keep = np.flatnonzero(100 * both >= percent * (n1 + n2 - both))
            yield batch.select(["a", "b"]).take(pa.array(keep))

    found = materialize(pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct())
    discard(sets)
    discard(wanted)
    return found


def _hub_links(slabs: DataFrame, known: DataFrame | None, tried: DataFrame | None, shared: DataFrame, texts: DataFrame, points: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of points with a hub of their slabs that were looked at, and those of them that link.

    The hub of a slab is the point that is in most slabs, so the least
    particular one.  Once components are known, it is the one from outside the
    component of the slab's first hub.
    """
    if known is None:
        entries = slabs.withColumn("component", F.col("v"))
        rest = entries
    else:
        entries = slabs.join(known, "v", "left").withColumn("component", F.coalesce("component", "v"))
        main = entries.groupBy("slab").agg(F.max_by("component", F.struct("degree", "v")).alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        rest = entries.join(main.select("slab", "main"), "slab").filter("component <> main")
    hubs = rest.groupBy("slab").agg(F.max(F.struct("degree", "v", "n", "component")).alias("hub"))
    near = entries.join(hubs, "slab").filter((F.col("component") != F.col("hub.component")) & sizes_fit(F.col("n"), F.col("hub.n"), percent))
    star = near.select(F.least("v", "hub.v").alias("a"), F.greatest("v", "hub.v").alias("b")).distinct()
    if tried is not None:
        star = star.join(tried, ["a", "b"], "left_anti")
    star = materialize(star)
    bounded = materialize(_bounded(star, shared, percent))
    links = _verified(bounded, texts, points, k, percent)
    discard(bounded)
    return star, links


def _named(lists: list[list[int]], other: bool) -> np.ndarray:
    """The points' first slabs as rows of NAMED; what is missing equals nothing of the other side."""
    out = np.full((len(lists), NAMED), np.iinfo(np.int64).max - other)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _point_pairs(v, n, c, x, s, slab: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that differ in component, fit in size and reach the threshold by their summed minima, the lesser id first.

    ``v``, ``n``, ``c``, ``x``, ``s``: ids, sizes, components, counts and first
    slabs of both sides.  A pair known to meet in a lesser slab than this one
    (``slab``: of each pair) is left to that.
    """
    ok = (v[0][i] != v[1][j]) & (c[0][i] != c[1][j]) & (n[0][i] * percent <= n[1][j] * 100) & (n[1][j] * percent <= n[0][i] * 100)
    i, j, slab = i[ok], j[ok], slab[ok]
    sums = [np.minimum(x[0][i[k : k + 8192]], x[1][j[k : k + 8192]]).sum(1, dtype=np.int64) for k in range(0, len(i), 8192)]
    ok = np.concatenate([np.zeros(0, np.int64), *sums]) >= need(n[0][i], n[1][j], percent)
    i, j, slab = i[ok], j[ok], slab[ok]
    least = np.full(len(i), np.iinfo(np.int64).max)
    for k in range(NAMED):
        name = s[0][i, k]
        least = np.minimum(least, np.where((s[1][j] == name[:, None]).any(1), name, least))
    ok = (least == slab) | (least == np.iinfo(np.int64).max)
    a, b = v[0][i[ok]], v[1][j[ok]]
    return np.minimum(a, b), np.maximum(a, b)


def _all_with_all(first: np.ndarray, size: np.ndarray, other_first: np.ndarray, other_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place of a range with each place of its counterpart, after the range's own place."""
    per = size * other_size
    row = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return row, first[row] + place // other_size[row], other_first[row] + place % other_size[row]


_TREE = "level int, slab long, top long, node long, page long, box array<long>, n1 long, n2 long, c1 long, c2 long, p array<struct<v:long,n:long,c:long,x:binary,s:array<long>>>, a long, b long"


class _Packer:
    """Packs the sorted entries of one partition: boxes for slabs of several pages or at the partition's ends, point pairs for the others."""

    def __init__(self, part: int, percent: int):
        self.part, self.percent = part, percent
        self.ids = [part << 40] * 3  # of page, node and top
        self.boxes: list[list | None] = [None, None]  # of the open node and top
        self.filled = [0, 0]
        self.held: list[tuple] = []
        self.slab, self.begun, self.first = None, False, True
        self.small: list[tuple[int, list[tuple]]] = []
        self.n_small = 0
        self.rows: list[dict] = []

    def add(self, slab: int, entry: tuple) -> None:
        """``entry``: v, n, component, counts, first slabs."""
        if slab != self.slab:
            self.finish(self.first)
            self.slab, self.first = slab, self.slab is None
        elif len(self.held) == PAGE:
            self._page()
        self.held.append(entry)

    def finish(self, boxed: bool) -> None:
        """Close the slab; ``boxed``: others of its points may lie in another partition."""
        if not self.held:
            return
        if boxed or self.begun:
            self._page()
            self._close(0)
            self._close(1)
        elif len(self.held) > 1:
            self.small.append((self.slab, self.held))
            self.n_small += len(self.held)
        self.held, self.begun = [], False

    def _row(self, level: int, box: list, points: list | None) -> None:
        page, node, top = self.ids
        x, n1, n2, c1, c2 = box
        self.rows.append({"level": level, "slab": self.slab, "top": top, "node": node, "page": page, "box": x.tolist(), "n1": n1, "n2": n2, "c1": c1, "c2": c2, "p": points})

    def _page(self) -> None:
        n, c = [h[1] for h in self.held], [h[2] for h in self.held]
        box = [np.stack([h[3] for h in self.held]).max(0), min(n), max(n), min(c), max(c)]
        self._row(0, box, [{"v": h[0], "n": h[1], "c": h[2], "x": h[3].astype(np.uint32).tobytes(), "s": h[4]} for h in self.held])
        for k, old in enumerate(self.boxes):
            self.boxes[k] = box if old is None else [np.maximum(old[0], box[0]), *(f(o, x) for f, o, x in zip((min, max, min, max), old[1:], box[1:]))]
        self.ids[0] += 1
        self.held, self.begun = [], True
        self.filled[0] += 1
        if self.filled[0] == FAN:
            self._close(0)
            if self.filled[1] == FAN:
                self._close(1)

    def _close(self, k: int) -> None:
        if self.boxes[k] is not None:
            self._row(k + 1, self.boxes[k], None)
            self.ids[k + 1] += 1
            self.boxes[k], self.filled[k] = None, 0
            if k == 0:
                self.filled[1] += 1

    def pairs(self) -> list[dict]:
        """Point pairs of the slabs of one page, once enough of them are held."""
        flat = [h for _, page in self.small for h in page]
        size = np.array([len(page) for _, page in self.small])
        slab = np.array([name for name, _ in self.small])
        first = np.cumsum(size) - size
        v, n, c = (np.array([h[k] for h in flat], np.int64) for k in range(3))
        x = np.stack([h[3] for h in flat])
        row, i, j = _all_with_all(first, size, first, size)
        half = i < j
        names = [h[4] for h in flat]
        a, b = _point_pairs((v, v), (n, n), (c, c), (x, x), (_named(names, False), _named(names, True)), slab[row[half]], i[half], j[half], self.percent)
        self.small, self.n_small = [], 0
        pairs = np.unique(np.stack([a, b]), axis=1)
        return [{"level": -1, "a": p, "b": q} for p, q in pairs.T.tolist()]


def _packed(entries: DataFrame, percent: int, slice_rows: int = 2048) -> DataFrame:
    """The tree below the slabs (see _TREE).

    level 0 is a page, 1 a node, 2 a top, with box, n1 and n2 (least and
    greatest size), c1 and c2 (least and greatest component), p (a page's
    points); level -1 is a pair (a, b) from a slab of one page.
    ``entries``: slab, v, n, counts, component, first (slabs).  A range sort deals the entries
    out, so a slab may go over any number of partitions; each packs its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    order = ["slab", "component", "n", "v"]
    ranged = entries.repartitionByRange(partitions(entries.sparkSession), *order).sortWithinPartitions(*order)
    ranged = ranged.select("slab", "v", "n", "component", "counts", "first", F.spark_partition_id().cast("long").alias("part"))
    schema = to_arrow_schema(StructType.fromDDL(_TREE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                some = batch.slice(at, slice_rows)
                packer = packer or _Packer(some.column("part")[0].as_py(), percent)
                for slab, v, n, c, raw, names in zip(*(some.column(x).to_pylist() for x in ("slab", "v", "n", "component", "counts", "first"))):
                    packer.add(slab, (v, n, c, vector(raw, n).reshape(COARSE, -1).sum(1), names))
                rows = packer.rows + (packer.pairs() if packer.n_small > 4 * slice_rows else [])
                packer.rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if packer:
            packer.finish(True)
            rows = packer.rows + (packer.pairs() if packer.small else [])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranged.mapInArrow(run, _TREE)


def _met(joined: DataFrame, percent: int) -> DataFrame:
    """Pairs of boxes (box, n1, n2, c1, c2 and the same with ``o_``) whose summed minima and sizes allow a link between components."""
    other = F.least("c1", "o_c1") < F.greatest("c2", "o_c2")
    fit = (F.col("n1") * percent <= F.col("o_n2") * 100) & (F.col("o_n1") * percent <= F.col("n2") * 100)
    most = F.aggregate(F.zip_with("box", "o_box", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    return joined.filter(other & fit).filter((100 + percent) * most >= percent * (F.col("n1") + F.col("o_n1")))


def _tree_pairs(tree: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of points of different components that share a slab and pass all boxes' bounds, and their own in the boxes' groups."""
    box = ["box", "n1", "n2", "c1", "c2"]

    def side(level: int, ids: list[str], other: bool) -> DataFrame:
        rows = tree.filter(F.col("level") == level).select(*ids, *box)
        return rows.toDF(*(f"o_{c}" for c in [*ids, *box])) if other else rows

    pairs = side(2, ["slab", "top"], False).join(side(2, ["slab", "top"], True), (F.col("slab") == F.col("o_slab")) & (F.col("top") <= F.col("o_top")))
    pairs = _met(pairs, percent).select("top", "o_top")
    for level, above, own in ((1, "top", "node"), (0, "node", "page")):
        pairs = pairs.join(side(level, [above, own], False), above).join(side(level, [above, own], True), f"o_{above}")
        pairs = _met(pairs.filter(F.col(own) <= F.col(f"o_{own}")), percent).select(own, f"o_{own}")
    pages = tree.filter("level = 0").select("slab", "page", "p")
    met = pairs.join(pages, "page").join(pages.select("page", "p").toDF("o_page", "q"), "o_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                lists = [some.column(c) for c in ("p", "q")]
                flat = [x.flatten() for x in lists]
                v, n, c = ([f.field(k).to_numpy() for f in flat] for k in range(3))
                x = [np.frombuffer(b"".join(f.field(3).to_pylist()), np.uint32).reshape(-1, COARSE) for f in flat]
                s = [_named(f.field(4).to_pylist(), bool(k)) for k, f in enumerate(flat)]
                size = [np.diff(np.asarray(t.offsets)) for t in lists]
                row, i, j = _all_with_all(np.cumsum(size[0]) - size[0], size[0], np.cumsum(size[1]) - size[1], size[1])
                a, b = _point_pairs(v, n, c, x, s, some.column("slab").to_numpy()[row], i, j, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    inside = tree.filter("level = -1").select("a", "b")
    return met.select("slab", "p", "q").mapInArrow(run, "a long, b long").unionByName(inside).distinct()


def _open_entries(slabs: DataFrame, percent: int) -> DataFrame:
    """The entries (slab, v, n, component) that have a point of another component and a size that may fit in their slab.

    Sizes are compared by bands as wide as the threshold allows, so that a
    slab's sizes are summed up and never gathered.
    """
    banded = slabs.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("long"))
    sums = banded.groupBy("slab", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    near = sums.select("slab", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "lo", "hi")
    near = near.groupBy("slab", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("slab", "band")
    return banded.join(near, ["slab", "band"]).select("slab", "v", "n", "component")


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bits: int = 27) -> DataFrame:
    """One row per row of ``docs``: id, th (:func:`copies.text_hash`), n_shingles, component_id.

    Two texts link when 100 * intersection >= percent * union of their sets of
    distinct ``shingle``-word shingles (a text of fewer words is one shingle).
    ``component_id`` is the smallest id reachable by links, itself included.
    Null texts and texts without words have no shingles and link with nothing,
    not even with one another.  Rows that repeat an id are texts of their own;
    a null id takes part, but is nobody's component id (alone it has null).
    A very long text is a slice of its own in a task and is compared whole.
    A pair exactly at the threshold links.  Other columns are not read.
    """
    context, key = docs.sparkSession.sparkContext, new_key()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = mark_copies(docs)
    texts = marked.filter("NOT copy AND text IS NOT NULL").select("t1", "t2", "text")
    mass = context.broadcast(group_mass(texts, shingle, key))

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in rows_of(batches, "text", SLICE):
            yield ShingleSets(batch.column("text"), shingle, key).leading(mass.value, percent)[0]

    flags = context.broadcast(repeated(texts, coordinates, bits))
    points = materialize(_points(texts, mass, flags, shingle, percent, key))
    shared = points.filter("counts IS NOT NULL").groupBy("g1", "g2").agg(F.min_by(F.struct("t1", "t2", "n", "slabs", "counts"), F.struct("t1", "t2")).alias("p"))
    shared = materialize(shared.select("g1", "g2", "p.*").withColumn("v", F.monotonically_increasing_id()))
    one_text = shared.select("v", "t1", "t2")
    slabs = shared.select("v", "n", F.size("slabs").alias("degree"), F.explode("slabs").alias("slab"))
    # Of slabs with the same points (a passage makes many) one is enough.
    who = F.bit_xor(F.xxhash64("v")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("x2")
    full = slabs.groupBy("slab").agg(F.count("*").alias("m"), *who).filter("m > 1").groupBy("m", "x1", "x2").agg(F.min("slab").alias("slab")).select("slab")
    slabs = materialize(slabs.join(full, "slab"))
    known, tried, links, n_links = None, None, None, 0
    for _ in range(HUB_ROUNDS):
        star, found = _hub_links(slabs, known, tried, shared, texts, one_text, shingle, percent)
        tried = star if tried is None else tried.unionByName(star)
        links = found if links is None else links.unionByName(found)
        if found.isEmpty():
            break
        known = materialize(components(links))
    entries = slabs.drop("degree") if known is None else slabs.drop("degree").join(known, "v", "left")
    entries = entries.withColumn("component", F.coalesce("component", "v") if known is not None else F.col("v"))
    entries = materialize(_open_entries(entries, percent))
    first = entries.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("slab")), 1, NAMED).alias("first"))  # as many as a text has leading coordinates
    entries = materialize(entries.join(shared.select("v", "counts").join(first, "v"), "v"))
    tree = materialize(_packed(entries, percent))
    discard(entries)
    rest = materialize(_tree_pairs(tree, percent).join(tried, ["a", "b"], "left_anti"))
    discard(tree)
    rest = materialize(_bounded(rest, shared, percent))
    more = _verified(rest, texts, one_text, shingle, percent)
    discard(rest)
    joined = components(links.unionByName(more))
    named = shared.select("g1", "g2", "v").join(joined, "v", "left").select("g1", "g2", F.coalesce("component", "v").alias("component"))
    classes = points.select("t1", "t2", "g1", "g2", "n").join(named, ["g1", "g2"], "left").dropDuplicates(["t1", "t2"])
    rows = marked.select("id", "t1", "t2", F.col("text").isNotNull().alias("real"))
    alone = F.col("component").isNull()
    rows = materialize(
        rows.join(classes, (rows.t1 == classes.t1) & (rows.t2 == classes.t2) & rows.real, "left").select(
            "id", rows.t1.alias("th"), F.coalesce("n", F.lit(0)).alias("n_shingles"), (F.coalesce("n", F.lit(0)) > 0).alias("live"),
            F.when(alone, F.col("g1")).otherwise(F.col("component")).alias("k1"), F.when(alone, F.col("g2")).alias("k2"),
        )
    )
    least = rows.filter("live").groupBy("k1", "k2").agg(F.min("id").alias("least")).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "least")
    out = rows.join(least, F.col("live") & (F.col("k1") == F.col("c1")) & F.col("k2").eqNullSafe(F.col("c2")), "left")
    return out.select("id", "th", "n_shingles", F.when(F.col("live"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
