"""Packing of token sequences by patterns of a few documents, fitted to the histogram of lengths.

Documents longer than a sequence are cut; what is left is a histogram of piece
lengths, which has at most ``size`` entries however many documents there are.
Patterns are sets of up to three lengths that fill a sequence.  How often each
is used is a non-negative least-squares problem: the lengths that the patterns
use up should be the histogram.  The solution is rounded to whole counts that
the histogram can supply, and the residual lengths go by best fit, longest
first, into the room that patterns left and into new sequences.

The plan is a table of (length, first ordinal, count, first sequence, offset).
Its rows are bounded by the number of patterns, not by the data.  A piece
finds its row by its ordinal among the pieces of its length: its number within
the task that cut it, plus what earlier tasks have of that length.  So no
piece is sorted or gathered, and tokens are not shuffled to be placed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import ByteLevel
from .pieces import Remembered, cut
from .session import bound_batches, materialize, small
from .tokens import rows_of

SIZE = 1024
#: The id that ends every document.
END = 2
#: Steps of the least-squares fit.
STEPS = 400
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Rows (task, length) of earlier counts up to which they are broadcast (some 24 bytes each).
BROADCAST_ROWS = 1_000_000


@functools.lru_cache(1)
def _encoder(path: str) -> Remembered:
    """A worker's encoder of pieces; each piece's ids are little-endian unsigned 32-bit integers."""
    model = ByteLevel(path, special=True)

    def ids(pieces: list[bytes]) -> list[bytes]:
        flat, at = model.pieces(pieces)
        raw, at = np.ascontiguousarray(flat, "<u4").tobytes(), (at * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    return Remembered(ids, lambda x: len(x) + 160)


def cut_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row a piece: ``keep`` columns, piece (from 0), start, length, ids (little-endian unsigned 32-bit), task, nth.

    A document is its text's tokens and ``end``; a null or empty text has the
    end alone.  A document beyond ``size`` tokens is cut so that all pieces
    but the first are full.  nth counts pieces of one length within a task.
    Each row of ``docs`` gives its own pieces, repeated and null ids included;
    very long texts are encoded whole, a slice of their own.  The table is
    written to the shared folder.  ``keep`` must not name a column of the output.
    """
    bound_batches(docs.sparkSession)
    names = list(dict.fromkeys(keep))
    df = docs.select(*names, F.col(text_col).alias("__text"), F.spark_partition_id().alias("__task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _encoder(path), int(end).to_bytes(4, "little")
        had = np.zeros(size + 1, np.int64)
        for batch in rows_of(batches, "__text", SLICE):
            which, first, distinct = cut(batch.column("__text"))
            get = encode(distinct).__getitem__
            row, piece, start, ids = [], [], [], []
            places, first = which.tolist(), first.tolist()
            for i, (a, b) in enumerate(zip(first, first[1:])):
                own = b"".join([*map(get, places[a:b]), last])
                n = len(own) // 4
                ends = range((n - 1) % size + 1, n + 1, size)
                at = 0
                for k, to in enumerate(ends):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    ids.append(own[at * 4 : to * 4])
                    at = to
            length = np.array([len(x) // 4 for x in ids], np.int64)
            order = np.argsort(length, kind="stable")
            runs = np.flatnonzero(np.diff(length[order], prepend=-1))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(runs, np.diff(np.append(runs, len(length))))
            nth += had[length]
            had += np.bincount(length, minlength=size + 1)
            own = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(own.column(c) for c in names), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()), own.column("__task"), pa.array(nth)],
                names=[*names, "piece", "start", "length", "ids", "task", "nth"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    return materialize(df.mapInArrow(run, f"{kept}{', ' if kept else ''}piece int, start long, length long, ids binary, task int, nth long"))


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths (zeros for fewer), the longest first, that fill ``size``, or as much of it as a third length can.

    ``present``: the lengths that occur, ascending.  For two lengths whose rest
    is no longer than they are, the third is the longest present within it.
    """
    a, b = (x.ravel() for x in np.meshgrid(present, present, indexing="ij"))
    rest = size - a - b
    use = (b <= a) & (rest >= 0) & (rest <= b)
    a, b, rest = a[use], b[use], rest[use]
    at = np.searchsorted(present, rest, side="right")
    third = np.where(at > 0, present[np.maximum(at - 1, 0)], 0)
    out = np.stack((a, b, third), axis=1)
    if len(present) and present[-1] == size:
        out = np.concatenate(([[size, 0, 0]], out))
    return out


def fitted(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative x with the least squared difference between the lengths that ``rows`` use x times and ``counts``.

    Accelerated projected gradient, each pattern scaled by its own norm; no
    matrix is built, as a pattern touches three lengths at most.
    """
    if not len(rows):
        return np.zeros(0)
    live = (rows > 0).astype(float)
    norm = 1 / np.sqrt(live.sum(1))
    weight = live * norm[:, None]

    def up(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (weight * x[:, None]).ravel(), len(counts))

    def down(r: np.ndarray) -> np.ndarray:
        return (weight * r[rows]).sum(1)

    v = np.ones(len(rows))
    for _ in range(30):  # the largest curvature, by power iteration
        w = down(up(v))
        top = np.linalg.norm(w)
        v = w / top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y - down(up(y) - counts) / (top * 1.02))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t2 * (after - x)
        if ((y - after) * (after - x)).sum() < 0:  # past the valley: start anew
            t2, y = 1.0, after
        x, t = after, t2
    return x * norm


def plan(counts: np.ndarray, size: int = SIZE, steps: int = STEPS) -> np.ndarray:
    """Rows (length, first ordinal, count, first sequence, offset) that place every piece; ``counts[n]``: pieces of length n.

    Row by row, ``count`` pieces of a length from the given ordinal on go into
    as many consecutive sequences at the given offset.  Sequences are numbered
    from 0 without a gap, and within each the offsets leave none.  The fit is
    rounded in several ways, of which the one with the fewest sequences stays.
    """
    have = np.zeros(size + 1, np.int64)
    have[: len(counts)] = counts
    rows = patterns(np.flatnonzero(have), size)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    x = fitted(rows, have.astype(float), steps)
    near = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)  # near patterns round together
    made = [_filled(have, rows, times, size) for times in (near, near * 3 // 4, near // 2, np.floor(x).astype(np.int64))]
    return min(made, key=lambda m: m[1])[0]


def _filled(counts: np.ndarray, rows: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The plan that uses the patterns ``times`` times, as far as pieces last, and its number of sequences."""
    left, ordinal, out, sequences = counts.copy(), np.zeros(size + 1, np.int64), [], 0
    room: dict[int, list[list[int]]] = {}  # by free tokens: [first sequence, count]

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        out.append((length, int(ordinal[length]), count, sequence, offset))
        ordinal[length] += count
        left[length] -= count

    used = np.flatnonzero(times)
    for i in used[np.argsort(-times[used], kind="stable")].tolist():
        lengths = [int(n) for n in rows[i] if n]
        many = min(int(times[i]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if many <= 0:
            continue
        at = 0
        for n in lengths:
            put(n, many, sequences, at)
            at += n
        if at < size:
            room.setdefault(size - at, []).append([sequences, many])
        sequences += many
    for n in range(size, 0, -1):  # the residual by best fit, the longest first
        while left[n]:
            free = min((f for f in room if f >= n), default=0)
            if not free:
                break
            group = room[free][-1]
            many = min(int(left[n]), group[1])
            put(n, many, group[0], size - free)
            if free > n:
                room.setdefault(free - n, []).append([group[0], many])
            group[0] += many
            group[1] -= many
            if not group[1]:
                room[free].remove(group)
                if not room[free]:
                    del room[free]
        if left[n]:
            each = size // n
            for fill, many in ((each, int(left[n]) // each), (int(left[n]) % each, 1)):
                if fill and many:
                    for j in range(fill):
                        put(n, many, sequences, j * n)
                    if size > fill * n:
                        room.setdefault(size - fill * n, []).append([sequences, many])
                    sequences += many
    return np.array(out, np.int64).reshape(-1, 5), sequences


def place(pieces: DataFrame, size: int = SIZE, steps: int = STEPS) -> DataFrame:
    """``pieces`` with sequence_id and offset instead of task and nth.

    Needs the columns length, task and nth of :func:`cut_documents`; the others
    pass through, so choose them first.  The driver gets one count a length.
    Pieces of one length, of which there may be any number, are counted by
    task; no task gathers them.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    held = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    rows = plan(counts, size, steps)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.searchsorted(rows[:, 0], np.arange(size + 2))  # a length's rows, in the order of ordinals
    earlier = held.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    earlier = earlier.select(F.col("task").alias("__task"), F.col("length").alias("__length"), F.coalesce("before", F.lit(0)).alias("__before"))
    df = pieces.join(small(earlier, BROADCAST_ROWS), (F.col("task") == F.col("__task")) & (F.col("length") == F.col("__length"))).drop("__task", "__length")
    names = [c for c in pieces.columns if c not in ("task", "nth")]
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            ordinal = batch.column("__before").to_numpy() + batch.column("nth").to_numpy()
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                row[mine] = first[n] + np.searchsorted(rows[first[n] : first[n + 1], 1], ordinal[mine], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(rows[row, 3] + ordinal - rows[row, 1]), pa.array(rows[row, 4])], names=[*names, "sequence_id", "offset"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return df.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (all pieces of a sequence one after another) and ends (where each piece ends), for training.

    ``placed`` must still hold ids.  A group is one sequence, so it is bounded
    by the sequence's size.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("__p")).select(
        "sequence_id", F.aggregate("__p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"),
        F.aggregate("__p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.transform("__p", lambda p: p.offset + p.length).alias("ends"),
    )
