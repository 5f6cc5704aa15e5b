"""Fixed-size summaries of sets of 64-bit hashes, for use as filters before exact joins.

A filter has a set number of bits whatever the data, so it can be broadcast at
any scale; as it fills up it lets more rows through to the exact join behind
it and never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import partitions


#: Bytes of hashes that the owner of a range holds, about.
RANGE_BYTES = 32 << 20


def hash_ranges(df: DataFrame, column: str = "text") -> int:
    """So many leading bits of a hash that a range of them holds some RANGE_BYTES of the words of ``column``, or windows of them: 8 bytes for each 4 of text at most."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]
    return max(6, (4 * partitions(df.sparkSession) - 1).bit_length(), (2 * size // RANGE_BYTES).bit_length())


def bitmap(df: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """2**bits flags: the top ``bits`` bits of each hash.  Gathers at most 2**(bits - 6) rows."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        df.select(F.shiftrightunsigned(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    bits = int(len(flags) * 64).bit_length() - 1
    slot = hashes >> np.uint64(64 - bits)
    return (flags[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def repeated(df: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int = 26, buffer: int = 1 << 20) -> np.ndarray:
    """Flags (2**bits) of the hashes that ``hashes_of`` yields more than once over all rows.

    Each array yielded holds a hash at most once for each document.  Tasks
    drop what they have already sent twice in a buffer, pack the rest by hash
    range, and a range's owner finds the repeats; a hash that a third of the
    rows hold is sent at most twice per buffer.  Ranges follow the bytes of
    ``text`` (see :func:`hash_ranges`), so that one fits a task.
    """
    shift = min(bits - 6, hash_ranges(df))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            keep = np.ones(len(h), bool)
            keep[2:] = h[2:] != h[:-2]
            h = h[keep]
            part = (h >> np.uint64(64 - shift)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part)) + 1
            at = np.concatenate(([0], cut, [len(h)]))
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 8), pa.py_buffer(h)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), blobs], names=["part", "hashes"])

        for h in hashes_of(batches):
            if len(h):
                held.append(h)
                n += len(h)
            if n >= buffer:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    width = 1 << (bits - shift - 6)

    def own(key: tuple, batches: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batches.column("hashes").combine_chunks()] or [np.zeros(0, np.uint64)]))
        h = h[1:][h[1:] == h[:-1]]
        slot = (h >> np.uint64(64 - bits)) & np.uint64(width * 64 - 1)
        flags = np.zeros(width, np.uint64)
        np.bitwise_or.at(flags, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        return pa.table({"part": [key[0].as_py()], "flags": [flags.tobytes()]}, schema=pa.schema([("part", pa.int64()), ("flags", pa.binary())]))

    rows = df.mapInArrow(pack, "part long, hashes binary").groupBy("part").applyInArrow(own, "part long, flags binary").toPandas()
    out = np.zeros(width << shift, np.uint64)
    for part, flags in zip(rows["part"], rows["flags"]):
        out[part * width : (part + 1) * width] = np.frombuffer(bytes(flags), np.uint64)
    return out
