"""Encoders of text pieces for two public vocabularies: byte-level BPE and sentence pieces with byte fallback."""

from __future__ import annotations

import json

import numpy as np
import sentencepiece
import tiktoken

from .bpe import _byte_letters
from .pieces import SAFE
from .tokens import ragged

#: The pattern that cuts text before the merges of a byte-level vocabulary (fixed value of its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE vocabulary, read from a tokenizer file whose ids follow the order of its merges.

    ``special``: whether strings of special tokens inside a text become these
    tokens; else they are plain text.
    """

    def __init__(self, path: str, special: bool):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in _byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        order = [vocab[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if order != sorted(order) or (order and min(order) < 256):
            raise ValueError(f"{path}: ids must follow the order of the merges")
        self.ranks = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=added)
        self.special = special
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in (*vocab.items(), *((t.encode(), i) for t, i in added.items())):
            self.bytes[i] = t
        self.width = np.array([len(t) for t in self.bytes], np.int64)

    def text(self, text: str) -> list[int]:
        return self.ranks.encode(text, allowed_special="all") if self.special else self.ranks.encode_ordinary(text)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and each one's offset into them.

        Pieces that begin with a space are put after one another, others
        behind a line feed, and encoded as one text; ids go back to pieces by
        their bytes.  Pieces with an unusual beginning are encoded alone.
        """
        spaced = [p[:1] == b" " for p in pieces]
        plain = [len(p) > s and bool(SAFE[p[s]]) for p, s in zip(pieces, spaced)]
        together = [i for i, x in enumerate(plain) if x]
        joined = b"".join(p if s else b"\n" + p for p, s, x in zip(pieces, spaced, plain) if x)
        ids = np.array(self.text(joined.decode(errors="replace")), np.uint32)
        begins = np.cumsum(self.width[ids]) - self.width[ids]
        size = np.array([len(pieces[i]) for i in together], np.int64)
        lead = np.array([not spaced[i] for i in together], np.int64)
        start = np.cumsum(size + lead) - size
        low, high = np.searchsorted(begins, start), np.searchsorted(begins, start + size)
        alone = [i for i, x in enumerate(plain) if not x]
        more = [np.array(self.text(pieces[i].decode(errors="replace")), np.uint32) for i in alone]
        pool = np.concatenate([ids, *more]) if more else ids
        first, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        first[together], count[together] = low, high - low
        sizes = np.array([len(x) for x in more], np.int64)
        first[alone], count[alone] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return pool[ragged(first, count)], np.concatenate(([0], np.cumsum(count)))


class SentencePieces:
    """A sentence-piece BPE model with byte fallback, without normalisation, that puts a space before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError(f"{path}: a piece has a space inside")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.width = np.array([len(t) for t in self.bytes], np.int64)
        self.space = self.model.piece_to_id("▁")

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of texts that begin with a space, and each one's offset into them.

        The model's own space is the piece's first; a piece without one is
        encoded behind a line feed, which no token spans, and that is left out.
        """
        texts = [(p[1:] if p[:1] == b" " else b"\n" + p).decode(errors="replace") for p in pieces]
        found = self.model.encode(texts, num_threads=1)
        own = [x if p[:1] == b" " else x[2:] for p, x in zip(pieces, found)]
        own = [x or [self.space] for x in own]  # a lone space
        count = np.array([len(x) for x in own], np.int64)
        flat = np.fromiter((i for x in own for i in x), np.uint32, int(count.sum()))
        return flat, np.concatenate(([0], np.cumsum(count)))
