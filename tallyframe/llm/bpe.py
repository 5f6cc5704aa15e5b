"""Byte-pair encoding and decoding of whole texts.

The encoder is the backtracking one: an Aho-Corasick automaton lists the
vocabulary's matches in a word, the longest match at each place is taken, and
a pair table says whether the merges would really leave two tokens side by
side; where they would not, a shorter match is tried and a dead end is marked
and left.  Each place of a word is visited a bounded number of times, so the
time is linear, and the tokens are exactly those of the merge order.  The
decoder is a table of offsets into the concatenated token strings.

Spark partitions the texts; in a task, texts are cut at ASCII white space, the
distinct pieces of a slice are normalised and split into words as one text, and
words are remembered up to a bound of bytes.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bound_batches
from .tokens import Words, binary_rows, ragged, rows_of

#: Bytes that a Python worker spends on remembered words, and the longest word (characters) that it remembers.
CACHE_BYTES, CACHE_WORD = 48 << 20, 64
#: What a remembered word takes besides its own characters (two bytes each) and its tokens.
CACHE_ENTRY = 220
#: Pairs of tokens of which a Python worker remembers whether they stay apart (some 130 bytes each).
SEAMS = 200_000
#: Bytes of text that are encoded and decoded at once.
SLICE = 1 << 20
#: Characters that stand after a piece and for a special token, in a text of pieces without ASCII white space.
PIECE, SPECIAL = "\n", "\t"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class WordBPE:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{v: k for k, v in vocab.items()}, **{v: k for k, v in self.special.items()}}
        self.strings = [names.get(i, "") for i in range(max(names) + 1)]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(f"{split}|[{PIECE}{SPECIAL}]")
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # Units are the bytes as characters, and the same with a word end from 256 on; ids in here are in merge order.
        ids: list[int] = []
        text: list[str] = []
        own: dict[str, int] = {}
        for b, letter in sorted(_byte_letters().items()):
            for name, u in ((letter, chr(b)), (letter + self.suffix, chr(256 + b))):
                own[name] = len(ids)
                ids.append(vocab[name])
                text.append(u)
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int] | None] = [None] * len(ids)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            name, pair = left + right, (own[left], own[right])
            if name not in own:
                own[name] = len(ids)
                ids.append(vocab[name])
                text.append(text[pair[0]] + text[pair[1]])
                self.split.append(pair)
            self.pairs.setdefault(pair, own[name])
        self.raw, self.length = [i.to_bytes(4, sys.byteorder) for i in ids], [len(t) for t in text]
        self.parts = [s or (i, i) for i, s in enumerate(self.split)]
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(text):
            if self.split[i] is None or self.compatible(*self.split[i], below=i):
                self.matches.add_word(t, i)
        # The next shorter match at a token's place, -1 if there is none.
        self.shorter = [next((self.matches.get(t[:k]) for k in range(len(t) - 1, 0, -1) if t[:k] in self.matches), -1) for t in text]
        self.matches.make_automaton()
        self.seams: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Start anew, so that the words of now are remembered."""
        self.known: dict[str, bytes] = {PIECE: b"", SPECIAL: bytes(4)}
        self.room = CACHE_BYTES

    def compatible(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side (``below``: looking at earlier merges only).

        The two tokens are taken apart again in reverse merge order; no pair
        that meets at the seam may have a merge that would have come first.
        """
        limit = below
        a, b = left, right
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        return True

    def word(self, raw: bytes) -> bytes:
        """The tokens of one word (unsigned 32-bit integers)."""
        length, shorter, seams, many = self.length, self.shorter, self.seams, len(self.length)
        # Matches come by their ends, so the longest one at a place comes last; the key is the place before.
        longest = {end - length[token]: token for end, token in self.matches.iter(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))}
        dead: set[int] = set()
        n, at, out, token = len(raw), 0, [], longest[-1]
        while at < n:
            while token >= 0:
                to = at + length[token]
                if to not in dead:
                    if not out:
                        break
                    pair = out[-1] * many + token
                    fits = seams.get(pair)
                    if fits is None:
                        if len(seams) >= SEAMS:
                            seams.clear()
                        fits = seams[pair] = self.compatible(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                if at < n:
                    token = longest[at - 1]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return b"".join([self.raw[t] for t in out])

    def _new(self, word: str) -> bytes:
        """The tokens of a word that is not remembered yet."""
        got = self.word(word.encode())
        if len(word) <= CACHE_WORD:
            size = CACHE_ENTRY + 2 * len(word) + len(got)
            if self.room < size:
                self.forget()
            self.room -= size
            self.known[word] = got
        return got

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of texts without ASCII white space, and how many each of them has.

        PIECE stands after each piece and SPECIAL for a special token; as white
        space they are no part of a word and nothing composes with them.
        """
        text, special = b"\n".join([*pieces, b""]).decode(), []
        if self.specials:
            special = [self.special[x] for x in self.specials.findall(text)]
            text = self.specials.sub(SPECIAL, text) if special else text
        words = self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        parts = [self.known.get(w) for w in words]
        for i in [i for i, p in enumerate(parts) if p is None]:
            got = self.known.get(words[i])
            parts[i] = self._new(words[i]) if got is None else got
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, ends = np.frombuffer(bytearray().join(parts), np.uint32), np.cumsum(size)
        if special:
            flat[ends[[i for i, w in enumerate(words) if w == SPECIAL]] - 1] = special
        return flat, np.diff(ends[size == 0], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts and each text's offset into them."""
        w = Words(texts, lower=False)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        which, distinct = w.coded()
        part = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct))) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(distinct)]
        flat, size = (np.concatenate(x) for x in zip(*(self.pieces(distinct[a:b]) for a, b in zip(cuts, cuts[1:]))))
        counts = size[which]
        ids = flat[ragged((np.cumsum(size) - size)[which], counts)]
        return ids, np.concatenate(([0], np.cumsum(counts)))[w.first]


class Decoder:
    """Token strings by id: one buffer and its offsets; tokens are joined by a space."""

    def __init__(self, strings: list[str]):
        raw = [(s + " ").encode() for s in strings]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        size = self.size[ids]
        data = self.data[ragged(self.offset[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[rows]
        keep = np.ones(len(data), bool)
        keep[ends[1:][rows[1:] > rows[:-1]] - 1] = False  # no space after a text's last token
        return binary_rows(data[keep], ends - np.concatenate(([0], np.cumsum(rows[1:] > rows[:-1])))).cast(pa.string())


@functools.lru_cache(1)
def _loaded(path: str) -> tuple[WordBPE, Decoder]:
    """One encoder for all tasks of a Python worker."""
    bpe = WordBPE(path)
    return bpe, Decoder(bpe.strings)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``keep`` columns or ``id_col``; n_tokens, ids: little-endian unsigned 32-bit integers, decoded: text).

    A null or empty text has no tokens and decodes to an empty text.  Every
    row of the input gives one row, repeated or null ids included; no other
    column is read.  A long text is a slice of its own.
    """
    bound_batches(docs.sparkSession)
    names = list(dict.fromkeys(keep or (id_col,)))
    df = docs.select(*names, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder = _loaded(path)
        for batch in rows_of(batches, "__text", SLICE):
            ids, rows = bpe.encode(batch.column("__text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.diff(rows)), binary_rows(np.ascontiguousarray(ids, "<u4").view(np.uint8), rows * 4), decoder.decode(ids, rows)],
                names=[*names, "n_tokens", "ids", "decoded"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    return df.mapInArrow(run, f"{kept}, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame, *keep: str) -> DataFrame:
    """The contract's columns, from the operator's output."""
    return coded.select(*keep, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
