"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

The word-end BPE never merges across white space, nor between a letter and a neighbouring
ASCII sign other than the apostrophe (or within a special token), so a text's ids are those of its segments in order.
"""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa

from . import words as W

#: Segments that a worker keeps before it starts anew.
KEPT = 400_000
_LETTER, _SIGN, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:128] = _SIGN
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0xC3:0xCA] = _LETTER  # leads of two-byte Latin letters
_KIND[[39, 60, 62, 124]] = _OTHER  # apostrophe, and the signs of special tokens: < > |
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return str(public_tokenizers.path(name))


def _byte_names() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte, as a translation of latin-1 text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids by segment, kept between slices of a task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.names = _byte_names()
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0
        # the slot last seen in each cell of a table by hash; ``key`` tells whether it is the word's
        self.cell = np.zeros(1 << 20, np.int64)
        self.key = np.zeros(1 << 14, W.U)

    def _learn(self, hashes: list[int], segments: list[bytes], letters: list[bool]) -> None:
        got: list = [None] * len(segments)
        others = []
        for k, (s, plain) in enumerate(zip(segments, letters, strict=True)):
            text = s.decode("utf-8", "replace") if plain else ""
            low = text.lower()
            if plain and len(low) == len(text):  # else lower-casing made a mark
                got[k] = [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.names))]
            else:
                others.append(k)
        if others:
            made = self.full.encode_batch_fast([segments[k].decode("utf-8", "replace") for k in others], add_special_tokens=False)
            for k, e in zip(others, made, strict=True):
                got[k] = e.ids
        sizes = np.array([len(x) for x in got], np.int32)
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
        n = len(self.slot)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(sizes) > len(self.size):
            self.at, self.size, self.key = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size, self.key))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(sizes)] = sizes
        self.key[n : n + len(sizes)] = np.array(hashes, W.U)
        self.used += len(flat)
        self.slot.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's first (one more entry than texts)."""
        words, letters = segments(texts)
        n = len(texts)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        h = words.hashes() ^ (letters.astype(W.U) * W.U(W.BASE))
        if len(self.slot) > KEPT:
            self.clear()
        cell = (h & W.U(len(self.cell) - 1)).astype(np.int64)
        slot = self.cell[cell]
        at = np.flatnonzero(self.key[slot] != h)
        if len(at):
            uniq, first, back = np.unique(h[at], return_index=True, return_inverse=True)
            keys = uniq.tolist()
            new = [k for k, x in enumerate(keys) if x not in self.slot]
            if new:
                where = at[first[new]]
                self._learn([keys[k] for k in new], [words.word(k) for k in where], letters[where].tolist())
            found = np.fromiter((self.slot[x] for x in keys), np.int64, len(keys))
            slot[at] = found[back]
            self.cell[cell[at[first]]] = found
        size = self.size[slot].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.at[slot] - (ends - size), size) + np.arange(int(ends[-1]))]
        return flat, np.concatenate((np.zeros(1, np.int64), ends))[words.first]


def segments(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    """Words split once more between letters and signs, and whether each is letters only."""
    words = W.split(texts)
    data = words.data
    if not len(data):
        return words, np.zeros(0, bool)
    kind = _KIND[data]
    tail = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    lead = tail[(tail > 0)]
    lead = lead[(data[lead - 1] >= 0xC3) & (data[lead - 1] < 0xCA)]
    sign = (data[lead - 1] == 0xC3) & ((data[lead] == 0x97) | (data[lead] == 0xB7))
    kind[lead] = np.where(sign, _OTHER, _LETTER)
    kind[lead[sign] - 1] = _OTHER
    cut = np.flatnonzero(((kind[1:] ^ kind[:-1]) == _LETTER ^ _SIGN) & (kind[1:] != _OTHER) & (kind[:-1] != _OTHER) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
    mark = np.zeros(len(data) + 1, bool)
    mark[words.start] = mark[cut] = True
    start = np.flatnonzero(mark)
    mark[:] = False
    mark[words.end] = mark[cut] = True
    end = np.flatnonzero(mark)
    first = np.searchsorted(start, words.begin)
    out = W.Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first, words.begin)
    strange = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind != _LETTER)))
    return out, strange[out.end] == strange[out.start]


_made: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer; Python workers are reused, and so are the words it knows."""
    kept = sys.modules[__name__].__dict__.setdefault("_made", {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]
