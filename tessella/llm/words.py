"""Words and shingles of whole texts as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and tab to carriage return; A-Z is lower-cased.
Hashes are 64 bits wide and depend on a word's bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text worked on at a time; a longer text is taken alone.
SLICE = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE + (1 << 18))
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, U), np.full(n - 1, b, U))), dtype=U)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    data: np.ndarray  # the bytes, lower-cased
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # index of each word's text
    first: np.ndarray  # each text's first word; one more entry than texts
    begin: np.ndarray  # each text's first byte; one more entry than texts

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        up, down = _power(len(self.data) + 1)
        total = np.concatenate((np.zeros(1, U), np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], dtype=U)))
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` bytes each."""
    size = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, int)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, int(size[at]) + most, "right")) - 1)
        yield at, to
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def split(texts: pa.Array, lower: bool = True) -> Words:
    """The words of an array of texts without nulls."""
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    begin = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    begin = begin - begin[0]
    data = _LOWER[raw] if lower else raw
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    edge = word[1:] != word[:-1]
    cut = begin[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[word[cut] & word[cut + 1]]  # two texts that meet without space
    change = np.flatnonzero(edge)
    start, end = change[0::2], change[1::2]
    if len(both):
        both = np.unique(both)
        start, end = np.sort(np.concatenate((start, both))), np.sort(np.concatenate((end, both)))
    first = np.searchsorted(start, begin)
    return Words(data, start, end, np.repeat(np.arange(n), np.diff(first)), first, begin)


def shingles(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of text) of each run of ``size`` words, in order; a shorter text is one run."""
    w = words.hashes() if hashes is None else hashes
    n = len(w)
    count = np.diff(words.first)
    if n >= size:
        h = w[: n - size + 1].copy()
        for k in range(1, size):
            h = mix(h * U(BASE) + w[k : n - size + 1 + k])
        ok = words.doc[: n - size + 1] == words.doc[size - 1 :]
        h, doc = h[ok], words.doc[: n - size + 1][ok]
    else:
        h, doc = np.zeros(0, U), np.zeros(0, np.int64)
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            at = words.first[short]
            x = w[at].copy()
            for j in range(1, k):
                x = mix(x * U(BASE) + w[at + j])
            h, doc = np.concatenate((h, mix(x + U(k)))), np.concatenate((doc, short))
    if len(doc) and (np.diff(doc) < 0).any():
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct hash, each element's number among these), in any order: a
    table by the low bits, and a sort of what collides there."""
    n = len(h)
    wide = 1 << (2 * n + 1).bit_length()
    cell = (h & U(wide - 1)).astype(np.int64)
    table = np.zeros(wide, np.int64)
    table[cell] = np.arange(n)
    at = table[cell]
    places = np.flatnonzero(at == np.arange(n))
    number = np.zeros(n, np.int64)
    number[places] = np.arange(len(places))
    back = number[at]
    odd = np.flatnonzero(h[at] != h)
    if len(odd):
        _, first, rest = np.unique(h[odd], return_index=True, return_inverse=True)
        back[odd] = len(places) + rest
        places = np.concatenate((places, odd[first]))
    return places, back


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted within the text (``doc`` must not fall)."""
    if not len(h):
        return h, doc
    out_h, out_d = [], []
    # the text's index in the top bits: one sort for up to 1,024 texts, 54 bits of hash left
    for lo in range(int(doc[0]), int(doc[-1]) + 1, 1024):
        a, b = np.searchsorted(doc, (lo, lo + 1024))
        key = np.sort(((doc[a:b] - lo).astype(U) << U(54)) | (h[a:b] >> U(10)))
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            out_h.append(key & U((1 << 54) - 1))
            out_d.append((key >> U(54)).astype(np.int64) + lo)
    return np.concatenate(out_h), np.concatenate(out_d)
