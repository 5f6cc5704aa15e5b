"""Vectorised tokenisation of Arrow text columns.

Texts are handled as one UTF-8 byte buffer per slice of rows.  Every word class
used here is closed over whole UTF-8 sequences (bytes from 0x80 up are word
bytes), so word limits can be found on bytes.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: The initial state of SipHash (fixed values of its definition).
_SIP = np.uint64(0x736F6D6570736575), np.uint64(0x646F72616E646F6D), np.uint64(0x6C7967656E657261), np.uint64(0x7465646279746573)
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def new_key() -> int:
    """A key for the word hashes of one job, the same in all its tasks; keys next to it are keys of their own."""
    return secrets.randbits(126)


def _turn(x: np.ndarray, bits: int) -> None:
    high = x >> np.uint64(64 - bits)
    x <<= np.uint64(bits)
    x |= high


def _sip_round(v: list[np.ndarray]) -> None:
    """One round of SipHash on arrays, in place."""
    v[0] += v[1]
    _turn(v[1], 13)
    v[1] ^= v[0]
    _turn(v[0], 32)
    v[2] += v[3]
    _turn(v[3], 16)
    v[3] ^= v[2]
    v[0] += v[3]
    _turn(v[3], 21)
    v[3] ^= v[0]
    v[2] += v[1]
    _turn(v[1], 17)
    v[1] ^= v[2]
    _turn(v[2], 32)


def rows_of(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``most`` bytes (a longer single text makes a slice of its own)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' offsets into them; null is empty."""
    texts = pc.fill_null(texts, "")
    kind, width = (np.int64, 8) if pa.types.is_large_string(texts.type) else (np.int32, 4)
    raw = texts.buffers()
    at = np.frombuffer(raw[1], kind, len(texts) + 1, texts.offset * width).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some rows: byte limits, the row's first word, 64-bit hashes."""

    def __init__(self, texts: pa.Array, word: np.ndarray = SPACED, lower: bool = True):
        raw, self.rows = text_bytes(texts)
        self.data = LOWER[raw] if lower else raw
        n = len(self.data)
        inside = word[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.rows[(self.rows > 0) & (self.rows < n)]  # a word ends with its row
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.rows)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self, key: int = 0) -> np.ndarray:
        """A keyed hash of each word's bytes (SipHash-1-3 over its 8-byte blocks, the length taken in first).

        Under a key drawn for a job (:func:`new_key`) no input can be made to
        collide; two keys make 128 bits.  Memory follows the number of words,
        not the longest text.
        """
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        secret = np.frombuffer(hashlib.blake2b(key.to_bytes(17, "little", signed=True), digest_size=16).digest(), np.uint64)
        state = [np.full(len(size), secret[i % 2] ^ c, np.uint64) for i, c in enumerate(_SIP)]
        state[3] ^= size.astype(np.uint64)
        data = np.concatenate((self.data, np.zeros(8, np.uint8)))
        blocks = np.ndarray((len(self.data) + 1,), "<u8", data, strides=(1,))  # the 8 bytes from every place on
        live, at, left = None, self.start, size
        if size.max() > LONG_WORD:
            live = np.flatnonzero(size <= LONG_WORD)
            for i in np.flatnonzero(size > LONG_WORD):
                raw = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, key=secret.tobytes())
                state[0][i] ^= np.uint64(int.from_bytes(raw.digest(), "little"))
            at, left = at[live], left[live]
        while len(left):
            block = blocks[at]
            short = left < 8
            block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            part = state if live is None else [v[live] for v in state]
            part[3] ^= block
            _sip_round(part)
            part[0] ^= block
            if live is not None:
                for v, x in zip(state, part):
                    v[live] = x
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
        state[2] ^= np.uint64(0xFF)
        for _ in range(3):
            _sip_round(state)
        return state[0] ^ state[1] ^ state[2] ^ state[3]

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """Each word's place in a list of the distinct words, told apart by their bytes."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), []
        edges = np.empty(2 * n, np.int64)  # words and the gaps between them are entries in turn
        edges[0::2], edges[1::2] = self.start, self.end
        data = pa.py_buffer(np.ascontiguousarray(self.data))
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(edges), data]).dictionary_encode()
        which = both.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64)
        used = np.flatnonzero(np.bincount(which, minlength=len(both.dictionary)))
        place = np.zeros(len(both.dictionary), np.int64)
        place[used] = np.arange(len(used))
        return place[which], both.dictionary.take(pa.array(used)).to_pylist()

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive entries, rows ignored; entry i is the run that starts at i.

    Each step shifts and multiplies, so it is no polynomial of the entries.
    """
    m = max(0, len(hashes) - k + 1)
    odd = np.uint64((2 * seed * 0x2545F4914F6CDD1D + 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    out = np.full(m, np.uint64(k * 2 + seed), np.uint64)
    for j in range(k):
        out ^= out >> np.uint64(29)
        out *= odd
        out += hashes[j : j + m]
    return mix(out)


def window_starts(counts: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The positions at which a run of ``k`` words of one row starts."""
    n = np.maximum(counts - k + 1, 0)
    return np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    return np.repeat(starts - before, lengths) + np.arange(total)


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the byte ranges between offsets."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))]
    ).cast(pa.binary())
