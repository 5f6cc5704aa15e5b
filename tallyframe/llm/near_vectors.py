"""Embedding near-dedup with randomised binary codes.

Vectors are scaled to length one and turned by seeded random rotations, once
each, into a row of the code table: the signs of the rotated vector as bits
(its code), the correction factor, which is the inner product of the vector
with its own code, and the rotated vector rounded at random to BITS bits, kept
as planes of bits.  Code times planes over the factor is an unbiased estimate
of the inner product of two vectors, counted on bits alone, and its spread is
known.  Only where the upper confidence bound of a pair reaches the threshold
are the two vectors fetched and multiplied in double precision.

Candidates come from tables keyed by runs of sign bits; their number and width
follow from the number of vectors, so that a pair just at the threshold is
missed by all tables with a chance of at most MISS (pairs well above it are
hardly ever missed), while unrelated vectors seldom meet.  Equal vectors are
one class with a weight.  A large bucket is dealt into blocks and its pairs of
blocks into tasks.  These pass on which of their members are in a possible
pair, and the pairs as one bit each; what is left of a pair of blocks, with
its vectors, gives link counts and a spanning forest, never the pairs.  A pair
that meets in several tables counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .session import discard, materialize

COSINE = 0.95
MISS = 0.02
BLOCK = 256
#: Bits of a coordinate of the rotated vector that codes are multiplied with.
BITS = 4
#: Spreads of an estimate allowed before a pair is ruled out.
CONFIDENCE = 4.0
SEED = 20240229


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, padded with zeros."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view("<i8")


class Codes:
    """Rotations for vectors of ``dim`` numbers, and the tables' bits."""

    def __init__(self, dim: int, rows: int, cosine: float, miss: float):
        apart = math.acos(cosine) / math.pi  # how often a bit differs at the threshold
        self.width = max(6, min(60, rows.bit_length() + 1))
        meet = (1 - apart) ** self.width
        self.tables = max(1, math.ceil(math.log(miss) / math.log1p(-meet)))
        turns = -(-self.width * self.tables // dim) if dim >= self.width else self.tables * self.width
        rng = np.random.default_rng(SEED + dim)
        self.rotations = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, turns))])
        self.dither = rng.random(dim)
        self.dim = dim
        self.words = -(-dim // 64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The key of each vector (row) in each table (column)."""
        bits = (unit @ self.rotations.T > 0)[:, : self.width * self.tables].reshape(len(unit), self.tables, self.width)
        return bits @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the first rotation: words of the code and of each plane, lowest first; factor, least coordinate and step of each vector."""
        turned = unit @ self.rotations[: self.dim].T
        factor = np.abs(turned).sum(1) / math.sqrt(self.dim)
        low, most = turned.min(1), (1 << BITS) - 1
        step = (turned.max(1) - low) / most
        rounded = np.clip(np.floor((turned - low[:, None]) / np.where(step > 0, step, 1.0)[:, None] + self.dither), 0, most).astype(np.int64)
        planes = [_words(rounded >> b & 1) for b in range(BITS)]
        return np.concatenate([_words(turned > 0), *planes], 1), np.column_stack((factor, low, step))

    def estimate(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For codes of ``a`` (rows) and planes of ``b`` (columns): estimates of the inner products, and the spread that rounding gives them."""
        # Unsigned: of a negative number the bits of its absolute value would be counted.
        signs, planes = a[0][:, : self.words].astype(np.uint64), b[0][:, self.words :].reshape(-1, BITS, self.words).astype(np.uint64)
        factor, low, step = a[1][:, :1], b[1][None, :, 1], b[1][None, :, 2]
        hit, whole = np.zeros((len(signs), len(planes)), np.int64), np.zeros(len(planes), np.int64)
        for bit in range(BITS):
            for w in range(self.words):
                hit += np.bitwise_count(signs[:, w, None] & planes[None, :, bit, w]).astype(np.int64) << bit
                whole += np.bitwise_count(planes[:, bit, w]).astype(np.int64) << bit
        ones = np.bitwise_count(signs).sum(1, dtype=np.int64)[:, None]
        product = (2 * (low * ones + step * hit) - low * self.dim - step * whole) / math.sqrt(self.dim)
        return product / factor, step / 2 / factor

    def possible(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cosine: float) -> np.ndarray:
        """Pairs that may reach the threshold: the estimate's distance from an inner product c is in proportion to the root of 1 - c * c, so the bound at the threshold holds above it too."""
        estimate, rounding = self.estimate(a, b)
        factor = np.minimum(a[1][:, :1], 1.0)
        turning = (1 - factor**2) / factor**2 / max(1, self.dim - 1) * (1 - cosine**2)
        return estimate + CONFIDENCE * np.sqrt(turning + rounding**2) >= cosine - 1e-9


def unit_rows(vectors: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one; None for what can link with nothing."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = np.array(v.as_py() if v.is_valid else [], float)  # a null component becomes NaN
        size = np.linalg.norm(x / (m or 1.0)) * m if len(x) and np.isfinite(m := np.abs(x).max()) else 0.0
        out.append(x / size if size > 0 and np.isfinite(size) else None)
    return out


def _joined(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a table of links between two sides, the least label each side's members share with what they are linked to."""
    far = link.shape[0] + link.shape[1]
    left, right = np.arange(link.shape[0]), np.arange(link.shape[0], far)
    while True:
        r = np.minimum(right, np.where(link, left[:, None], far).min(0, initial=far))
        q = np.minimum(left, np.where(link, r[None, :], far).min(1, initial=far))
        if (q == left).all() and (r == right).all():
            return q, r
        left, right = q, r


def near_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows linked directly), component_id (least id reachable), kept (id = component_id).

    Only vectors of one dimension are compared.  Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing and are
    their own component.  Rows repeating an id are vectors of their own; a
    null id takes part but names no component (alone it has null, not kept).
    Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).withColumns({"e1": F.xxhash64("x"), "e2": F.xxhash64(F.lit(1), F.col("x"))})
    good = rows.filter(F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0))
    sizes = good.groupBy("e1", "e2").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("x").alias("x"))
    classes = materialize(sizes.withColumn("v", F.monotonically_increasing_id()).withColumn("dim", F.size("x")))
    counted = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row per dimension
    parts = [_dimension(classes.filter(F.col("dim") == dim).select("v", "weight", "x"), Codes(dim, n, cosine, miss), cosine) for dim, n in sorted(counted.items())]
    found = parts[0] if parts else classes.select("v", F.lit(0).cast("long").alias("links"), F.col("v").alias("root"))
    for p in parts[1:]:
        found = found.unionByName(p)
    found = materialize(found)
    discard(*parts)
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(found.filter("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("e1", "e2", "v", "weight", "least").join(links, "v", "left").join(joined, "v", "left").withColumn("component", F.coalesce("component", "v"))
    labelled = materialize(labelled)
    discard(found, classes)
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(names, "component").select("e1", "e2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    # Bad vectors are told apart by their own hash: no class of good ones has it.
    return rows.select("id", "e1", "e2").join(labelled.withColumn("good", F.lit(True)), ["e1", "e2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """For a column of lists of structs: where each list begins (and the last ends), and the fields' numbers, one row for each struct."""
    sizes = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    out = []
    for name in fields:
        part = flat.field(name)
        values = part.flatten() if pa.types.is_list(part.type) else part
        values = values.to_numpy(zero_copy_only=False)
        out.append(values.reshape(len(flat), -1) if pa.types.is_list(part.type) and len(flat) else values)
    return np.concatenate(([0], np.cumsum(sizes))), out


def _dimension(classes: DataFrame, codes: Codes, cosine: float) -> DataFrame:
    """v, links (weights of the classes it links to), root (a class that it is joined to), for one dimension."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = np.stack(unit_rows(part.column("x")))
                code, stats = codes.code(unit)
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array(list(code)), pa.array(list(stats)), pa.array(list(codes.keys(unit)))], names=["v", "c", "s", "keys"])

    table = materialize(classes.select("v", "x").mapInArrow(coded, "v long, c array<long>, s array<double>, keys array<long>"))
    entries = table.select("v", F.posexplode("keys").alias("t", "k"))
    shared = entries.groupBy("t", "k").agg(F.count("*").alias("m")).filter("m > 1")
    dealt = entries.join(shared, ["t", "k"]).select("v", "t", "k", F.pmod(F.xxhash64("v"), F.ceil(F.col("m") / BLOCK).cast("long")).alias("block"))
    held = materialize(dealt.join(table.drop("keys"), "v").groupBy("t", "k", "block").agg(F.collect_list(F.struct("v", "c", "s")).alias("p")))
    others = held.select("t", "k", F.col("block").alias("block2"), F.col("p").alias("q"))
    pairs = held.join(others, ["t", "k"]).filter("block <= block2").select("t", "k", "block", "block2", "p", "q")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at1, (v1, c1, s1)), (at2, (v2, c2, s2)) = (_lists(batch.column(side), "v", "c", "s") for side in ("p", "q"))
            same = (batch.column("block").to_numpy() == batch.column("block2").to_numpy()).tolist()
            rows, left, right, mask = [], [], [], []
            for r in range(batch.num_rows):
                i, j = slice(at1[r], at1[r + 1]), slice(at2[r], at2[r + 1])
                if same[r] and at1[r + 1] - at1[r] < 2:
                    continue
                ok = codes.possible((c1[i], s1[i]), (c2[j], s2[j]), cosine)
                if same[r]:  # one block on both sides, in one order: each pair once
                    ok = np.triu(ok | ok.T, 1)
                if not ok.any():
                    continue
                a, b = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                rows.append(r)
                left.append(v1[i][a])
                right.append(v2[j][b])
                mask.append(np.packbits(ok[np.ix_(a, b)]).tobytes())
            kept = batch.select(["t", "k", "block", "block2"]).take(pa.array(rows, pa.int64()))
            ids = [pa.array(side, pa.list_(pa.int64())) for side in (left, right)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *ids, pa.array(mask, pa.binary())], names=["t", "k", "block", "block2", "left", "right", "mask"])

    found = pairs.mapInArrow(estimate, "t int, k long, block long, block2 long, left array<long>, right array<long>, mask binary")
    found = materialize(found.withColumn("pair", F.monotonically_increasing_id()))
    discard(held)
    members = found.select("pair", F.explode(F.array_union("left", "right")).alias("v"))
    # Whole vectors move only for what may be linked.
    fetched = members.join(classes.join(table.select("v", "keys"), "v"), "v").groupBy("pair").agg(F.collect_list(F.struct("v", "weight", "x", "keys")).alias("p"))
    fetched = found.select("pair", "t", "left", "right", "mask").join(fetched, "pair").select("t", "left", "right", "mask", "p")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, links, root = [], [], []
            at, (names, weights, xs, keys) = _lists(batch.column("p"), "v", "weight", "x", "keys")
            for r, (t, left, right, mask) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "left", "right", "mask")))):
                own = slice(at[r], at[r + 1])
                order = np.argsort(names[own])
                v1, v2 = np.array(left), np.array(right)
                i, j = (at[r] + order[np.searchsorted(names[own], side, sorter=order)] for side in (v1, v2))
                x, y = (s / np.abs(s).max(1, keepdims=True) for s in (xs[i].astype(float), xs[j].astype(float)))  # so that no square overflows
                x, y = (s / np.linalg.norm(s, axis=1, keepdims=True) for s in (x, y))
                link = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(v1) * len(v2)).reshape(len(v1), len(v2)).astype(bool)
                link &= x @ y.T >= cosine
                for earlier in range(t):
                    link &= keys[i, earlier][:, None] != keys[j, earlier][None, :]
                if not link.any():
                    continue
                r1, r2 = _joined(link)
                name = np.concatenate((v1, v2))
                for ids, on, count, part in ((v1, link.any(1), link @ weights[j], r1), (v2, link.any(0), weights[i] @ link, r2)):
                    v += ids[on].tolist()
                    links += count[on].tolist()
                    root += name[part][on].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["v", "links", "root"])

    out = materialize(fetched.mapInArrow(compare, "v long, links long, root long"))
    discard(table, found)
    return out
