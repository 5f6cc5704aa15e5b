"""Texts cut into pieces that byte-level and sentence-piece encoders treat on their own.

A cut is made before a single space, and before and after a line feed, where a
character follows that can be no white space and no start of a special token.
No token of either vocabulary spans such a cut, and what stands left of it
does not change the tokens on its right, so a text's tokens are those of its
pieces one after another, and each distinct piece is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .tokens import text_bytes

#: Bytes after which a cut may be made: none that begin or are white space (C2, E1, E2 and E3 lead it in UTF-8), no ``<``.
SAFE = np.ones(256, bool)
SAFE[[*range(9, 14), *range(28, 33), 0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each piece's place in the list of distinct pieces, each text's first piece (and the end), the distinct pieces."""
    data, rows = text_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64), []
    mark = np.zeros(n + 1, bool)
    at = np.flatnonzero((data[:-1] == 32) | (data[:-1] == 10))
    at = at[SAFE[data[at + 1]]]
    last = np.zeros(n, bool)
    last[rows[1:][rows[1:] > 0] - 1] = True  # the next byte is another text's
    at = at[~last[at]]
    feed = data[at] == 10
    mark[at[feed | (data[np.maximum(at - 1, 0)] != 32)]] = True
    mark[at[feed] + 1] = True
    mark[rows] = True
    mark[n] = False
    start = np.flatnonzero(mark)
    edges = pa.py_buffer(np.append(start, n))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(start, rows), coded.dictionary.to_pylist()


class Remembered:
    """What ``make`` gives for pieces (a list at a time), kept for short pieces up to so many bytes in all.

    There are two halves: as the newer one fills up, it becomes the older one,
    and what is asked for again moves back into the newer.
    """

    def __init__(self, make: Callable[[list[bytes]], list], cost: Callable[[object], int], room: int = 96 << 20, longest: int = 48):
        self.make, self.cost, self.room, self.longest = make, cost, room // 2, longest
        self.known: dict[bytes, object] = {}
        self.older: dict[bytes, object] = {}
        self.left = self.room

    def _keep(self, piece: bytes, x: object) -> None:
        self.left -= self.cost(x) + len(piece)
        if self.left < 0:
            self.older, self.known = self.known, {}
            self.left = self.room - self.cost(x) - len(piece)
        self.known[piece] = x

    def __call__(self, pieces: list[bytes]) -> list:
        out = list(map(self.known.get, pieces))
        older = self.older
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            x = older.get(pieces[i])
            if x is None:
                new.append(i)
            else:
                out[i] = x
                self._keep(pieces[i], x)
        for i, x in zip(new, self.make([pieces[i] for i in new]) if new else ()):
            out[i] = x
            if len(pieces[i]) <= self.longest:
                self._keep(pieces[i], x)
        return out
