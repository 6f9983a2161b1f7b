"""SentencePiece encoding and decoding with the N best segmentations of whole texts.

The lattice of a text has an edge for every piece that spells a stretch of it, and for a
character without a piece one edge of its bytes; a segmentation scores the sum of its pieces'
scores.  Forward Viterbi scores are exact heuristics for an A-star search from the end
backwards, so hypotheses leave the agenda best first and the first N are the N best.

No piece goes on past a word's end, so the lattice falls into segments.  Each distinct segment
is decoded once, in numpy, by forward and backward Viterbi scores, whose edges off the best
path give the gap to its second best.  Of a text's segments only those with the N - 1 least
gaps can be otherwise in its N best; they alone are searched, and their lists combined.

Defined results: null and empty texts have no pieces, score 0 and one segmentation; equal
scores go to the segmentation that differs earlier in the text; fewer than N exist for short
texts; repeated rows get a row each; an empty table gives none.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare
from .tokens import tokenizer_path

U = np.uint64
UNKNOWN = 10.0
#: Segments that a worker keeps before it starts anew.
KEPT = 600_000
LOW = -1e300
#: Longer segments have their edges found in numpy, and are passed alone.
SHORT = 4096


def _passed(start: np.ndarray, end: np.ndarray, value: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(start, end, score, number) of edges in an order, a slice of plain numbers at a time."""
    for a in range(0, len(order), 1 << 16):
        x = order[a : a + (1 << 16)]
        yield from zip(start[x].tolist(), end[x].tolist(), value[x].tolist(), x.tolist(), strict=True)


def _forward(size: int, start: np.ndarray, end: np.ndarray, value: np.ndarray, order: np.ndarray) -> tuple[list[float], list[int]]:
    """Best score up to each place of one segment and the edge that it ends with, by edges in the
    order of their ends."""
    ahead, came = [0.0] + [LOW] * size, [-1] * (size + 1)
    for p, e, v, k in _passed(start, end, value, order):
        if ahead[p] + v > ahead[e]:
            ahead[e], came[e] = ahead[p] + v, k
    return ahead, came


class Lattice:
    """A piece model's edges; the piece mark U+2581 is a space throughout."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.zeros(256, np.int64)
        self.spelt: list[bytes] = []
        ids, scores, raw = [], [], []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.spelt.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.spelt.append(b"")
            else:
                b = piece.replace("▁", " ").encode()
                self.spelt.append(b)
                ids.append(k)
                scores.append(sp.get_score(k))
                raw.append(b)
        self.scores = np.zeros(len(self.spelt))
        self.scores[ids] = scores
        self.unknown = min(s for s in scores if s > -1e8) - UNKNOWN  # far lower scores mark pieces that merging never makes
        self.widest = max(map(len, raw))
        self.known = dict(zip(raw, ids, strict=True))
        self.long = np.array([len(b) for b in self.spelt])
        self.text_at = np.cumsum(self.long) - self.long
        self.text = np.frombuffer(b"".join(self.spelt), np.uint8)
        used = np.zeros(256, bool)
        for b in raw:
            used[list(b)] = True
        #: Bytes that are a character without a piece: they always stand alone.
        self.alone = ~used & (np.arange(256) < 128)
        if any(32 in b.lstrip(b" ") for b in raw):
            raise ValueError("a piece of this model goes on past a word's end")
        ends = np.cumsum([len(b) for b in raw])
        begin = np.concatenate((np.zeros(1, np.int64), ends))
        h = W.Words(np.frombuffer(b"".join(raw), np.uint8), begin[:-1], ends, np.arange(len(raw)), np.arange(len(raw) + 1), begin).hashes()
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(ids)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(h & U((1 << 20) - 1)).astype(np.int64)] = True
        self.clear()

    def clear(self) -> None:
        """Forget all segments.  Known ones lie in growing columns: score and gap of the best
        path, its ids, and the segment's bytes."""
        self.slot: dict[int, int] = {}
        self.lists: dict[int, list] = {}
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.path = np.zeros(0, np.int32)
        self.begin, self.stop = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw = bytearray()

    def edges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of all edges within the segments, id -1 for bytes of a character."""
        up, down = W._power(len(data) + 1)
        total = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)))
        head = (data & 0xC0) != 0x80
        stop = np.repeat(end, end - start)
        place = np.repeat(start - np.concatenate((np.zeros(1, np.int64), np.cumsum(end - start)[:-1])), end - start) + np.arange(int((end - start).sum()))
        ok = head[place]
        place, stop = place[ok], stop[ok]
        char = np.ones(len(place), np.int64)  # bytes of the character at each place
        for k in (1, 2, 3):
            at = place + k
            char += (at < stop) & ~head[np.minimum(at, len(data) - 1)] & (char == k)
        got = []
        for n in range(1, self.widest + 1):
            at = np.flatnonzero(place + n <= stop)
            p = place[at]
            to = p + n
            good = (to == stop[at]) | head[np.minimum(to, len(data) - 1)]
            at, p = at[good], p[good]
            h = W.mix((total[p + n] - total[p]) * down[p] + U(n))
            at = at[self.sieve[(h & U((1 << 20) - 1)).astype(np.int64)]]
            p = place[at]
            h = W.mix((total[p + n] - total[p]) * down[p] + U(n))
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[k] == h
            got.append((at[hit], np.full(int(hit.sum()), n), self.ids[k[hit]]))
        at, n, ident = (np.concatenate(x) for x in zip(*got, strict=True))
        have = np.zeros(len(place), bool)
        have[at[n == char[at]]] = True
        miss = np.flatnonzero(~have)
        return np.concatenate((place[at], place[miss])), np.concatenate((n, char[miss])), np.concatenate((ident, np.full(len(miss), -1)))

    def learn(self, hashes: list[int], segments: list[bytes]) -> None:
        """Best path, score and gap of new segments, by length."""
        order = sorted(range(len(segments)), key=lambda k: len(segments[k]))
        made: list[tuple] = []
        a = 0
        while a < len(order):
            b = a
            while b < len(order) and (b == a or len(segments[order[b]]) <= SHORT) and (b - a + 1) * (len(segments[order[b]]) + 1) <= 1 << 18:
                b += 1
            b = max(b, a + 1)
            made.append(self._viterbi([segments[k] for k in order[a:b]]))
            a = b
        base = len(self.score)
        score, gap, size, path = (np.concatenate([x[k] for x in made]) for k in range(4))
        length = np.array([len(segments[k]) for k in order], np.int64)
        self.at = np.concatenate((self.at, len(self.path) + np.cumsum(size) - size))
        self.begin = np.concatenate((self.begin, len(self.raw) + np.cumsum(length) - length))
        self.stop = np.concatenate((self.stop, len(self.raw) + np.cumsum(length)))
        self.raw += b"".join([segments[k] for k in order])
        self.score, self.gap, self.size, self.path = (np.concatenate(x) for x in ((self.score, score), (self.gap, gap), (self.size, size), (self.path, path)))
        self.slot.update(zip([hashes[k] for k in order], range(base, base + len(order)), strict=True))

    def _viterbi(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score, gap to the second best, number of ids, and all ids in a row."""
        m = len(some)
        size = np.array([len(s) for s in some])
        data = np.frombuffer(b"".join(some), np.uint8)
        end = np.cumsum(size)
        start = end - size
        place, n, ident = self.edges(data, start, end)
        seg = np.searchsorted(end, place, "right")
        at = place - start[seg]
        value = np.where(ident >= 0, self.scores[ident], self.unknown)
        if m == 1:
            return self._alone(data, place, n, ident, value)
        width = int(size.max())
        # places in columns, so that a column of all segments lies together
        ahead, back = np.full((width + 1) * m, LOW), np.full((width + 1) * m, LOW)
        ahead[:m] = 0
        back[size * m + np.arange(m)] = 0
        came = np.zeros((width + 1) * m, np.int64)
        source, target = at * m + seg, (at + n) * m + seg
        by_end = np.lexsort((n, at + n))
        key = ((at + n) * (self.widest + 1) + n)[by_end]
        cut = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1], np.ones(1, bool))))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # one end and one length at a time: a segment occurs once
            x = by_end[lo:hi]
            to = target[x]
            new = ahead[source[x]] + value[x]
            better = new > ahead[to]
            ahead[to[better]] = new[better]
            came[to[better]] = x[better]
        by_start = np.lexsort((n, -at))
        key = (at * (self.widest + 1) + n)[by_start]
        cut = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1], np.ones(1, bool))))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            x = by_start[lo:hi]
            to = source[x]
            back[to] = np.maximum(back[to], back[target[x]] + value[x])
        on = np.zeros(len(place), bool)
        steps, now, live = [], size.copy(), np.flatnonzero(size > 0)
        while len(live):
            e = came[now[live] * m + live]
            on[e] = True
            steps.append(e)
            now[live] -= n[e]
            live = live[now[live] > 0]
        top = ahead[size * m + np.arange(m)]
        through = np.where(on, LOW, ahead[source] + value + back[target])
        second = np.full(m, LOW)
        np.maximum.at(second, seg, through)
        e = np.concatenate(steps)
        e = e[np.argsort(place[e], kind="stable")]
        many = np.where(ident[e] >= 0, 1, n[e])
        path = np.repeat(ident[e], many)
        odd = np.flatnonzero(path < 0)
        if len(odd):
            offset = np.arange(len(path)) - np.repeat(np.cumsum(many) - many, many)
            path[odd] = self.bytes[data[np.repeat(place[e], many)[odd] + offset[odd]]]
        return top, np.where(second > LOW / 2, top - second, np.inf), np.bincount(seg[e], many, m).astype(np.int64), path.astype(np.int32)

    def _alone(self, data: np.ndarray, place: np.ndarray, n: np.ndarray, ident: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``_viterbi`` of one segment, whose edges are passed one by one."""
        ahead, came = _forward(len(data), place, place + n, value, np.lexsort((n, place + n)))
        back = [LOW] * len(data) + [0.0]
        for p, e, v, _ in _passed(place, place + n, value, np.lexsort((n, -place))):
            if back[e] + v > back[p]:
                back[p] = back[e] + v
        on = []
        e = len(data)
        while e > 0:
            on.append(came[e])
            e = int(place[came[e]])
        best = np.array(on[::-1], np.int64)
        through = np.array(ahead)[place] + value + np.array(back)[place + n]
        through[best] = LOW
        second = through.max(initial=LOW)
        many = np.where(ident[best] >= 0, 1, n[best])
        path = np.repeat(ident[best], many)
        odd = np.flatnonzero(path < 0)
        offset = np.arange(len(path)) - np.repeat(np.cumsum(many) - many, many)
        path[odd] = self.bytes[data[np.repeat(place[best], many)[odd] + offset[odd]]]
        gap = ahead[-1] - second if second > LOW / 2 else np.inf
        return np.array([ahead[-1]]), np.array([gap]), np.array([len(path)]), path.astype(np.int32)

    def _into(self, data: bytes) -> Callable[[int], list[tuple[int, float, int]]]:
        """The edges (place, score, id) into each place of a segment, longest first."""
        if len(data) > SHORT:
            place, n, ident = self.edges(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]))
            order = np.lexsort((place, place + n))
            first = np.searchsorted((place + n)[order], np.arange(len(data) + 2))
            place, ident = place[order], ident[order]
            value = np.where(ident >= 0, self.scores[ident], self.unknown)
            return lambda e: list(zip(*(x[first[e] : first[e + 1]].tolist() for x in (place, value, ident)), strict=True))
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(data) + 1)]
        heads = [k for k in range(len(data) + 1) if k == len(data) or data[k] & 0xC0 != 0x80]
        for k, p in enumerate(heads[:-1]):
            for e in heads[k + 1 :]:
                if e - p > self.widest:
                    break
                i = self.known.get(data[p:e], -1)
                if i >= 0:
                    into[e].append((p, float(self.scores[i]), i))
                elif e == heads[k + 1]:
                    into[e].append((p, self.unknown, -1))
        return into.__getitem__

    def search(self, segment: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations (score, ids): A-star from the end, its heuristic the
        forward Viterbi score of what is left, which no completion exceeds and the best meets.

        Entries of the agenda name the entry they came from, and paths are spelt for the ``n``
        that win.  The best path's own detours, one edge each, are as many different paths, so
        nothing under the (n-1)-th of them is put on the agenda; and what leaves a place after
        ``n`` better ones have left it cannot win."""
        data, size = segment, len(segment)
        into = self._into(data)
        ahead, came = [0.0] + [LOW] * size, [-1] * (size + 1)
        for e in range(1, size + 1):
            for p, v, _ in into(e):
                if ahead[p] + v > ahead[e]:
                    ahead[e], came[e] = ahead[p] + v, p
        detours: list[float] = []
        e, g = size, 0.0
        while e > 0:
            step = 0.0
            for p, v, _ in into(e):
                if p == came[e]:
                    step = v
                elif ahead[p] > LOW / 2:
                    heapq.heappush(detours, ahead[p] + v + g)
                    if len(detours) > max(n - 1, 1):
                        heapq.heappop(detours)
            e, g = came[e], g + step
        floor = min(ahead[-1], detours[0]) if 0 < n - 1 <= len(detours) else ahead[-1] if n == 1 else LOW / 2
        floor -= 1e-15 * size * (1 + abs(floor))  # sums from both sides round differently
        at, parent, ident, score = array("q", [size]), array("q", [-1]), array("q", [-1]), array("d", [0.0])
        left = bytearray(size + 1) if n < 256 else [0] * (size + 1)
        agenda: list[tuple[float, int]] = [(-ahead[-1], 0)]
        out: list[tuple[float, list[int]]] = []
        while agenda and len(out) < n:
            k = heapq.heappop(agenda)[1]
            e, g = at[k], score[k]
            if not e:
                ids: list[int] = []
                while parent[k] >= 0:
                    up = parent[k]
                    ids += [ident[k]] if ident[k] >= 0 else [int(self.bytes[x]) for x in data[at[k] : at[up]]]
                    k = up
                out.append((g, ids))
                continue
            if left[e] >= n:
                continue
            left[e] += 1
            for p, v, i in into(e):
                f = g + v + ahead[p]
                if f >= floor:
                    heapq.heappush(agenda, (-f, len(at)))
                    at.append(p)
                    parent.append(k)
                    ident.append(i)
                    score.append(g + v)
        return out

    def segments(self, texts: pa.Array) -> W.Words:
        """Segments of texts that begin with a space each: words with the spaces before them."""
        n = len(texts)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        begin = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
        begin = begin - begin[0]
        open_ = np.zeros(len(data) + 1, bool)
        open_[begin] = True
        space, alone = data == 32, self.alone[data]
        open_[1:-1] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        start = np.flatnonzero(open_[:-1])
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, begin)
        return W.Words(data, start, end, np.repeat(np.arange(n), np.diff(first)), first, begin)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a sequence of ids, without the space that encoding put before it."""
        return b"".join(self.spelt[i] for i in ids.tolist())[1:]

    def encode(self, texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, list[tuple[float, list[tuple[int, list[int]]]]], float, bool]]:
        """For each text: best ids, its N best as (score, changes from the best by segment), the
        best score, and whether the ids decode to the text."""
        marked = pc.match_substring(texts, "▁").to_numpy(zero_copy_only=False)  # read as a space, so decoding cannot give it back
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), pc.replace_substring(texts, "▁", " "), pa.scalar("", texts.type)))
        words = self.segments(texts)
        if len(self.slot) > KEPT:
            self.clear()
        h = words.hashes()
        one, back = W.index(h)
        keys = h[one].tolist()
        new = [k for k, x in enumerate(keys) if x not in self.slot]
        if new:
            self.learn([keys[k] for k in new], [words.word(k) for k in one[new]])
        slot = np.fromiter((self.slot[x] for x in keys), np.int64, len(keys))[back]
        size, gaps = self.size[slot], self.gap[slot]
        ends = np.cumsum(size)
        flat = self.path[np.repeat(self.at[slot] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edge = np.concatenate((np.zeros(1, np.int64), ends))[words.first]
        total = np.bincount(words.doc, self.score[slot], len(texts))
        # all texts are decoded at once
        long = self.long[flat]
        spelt_end = np.cumsum(long)
        spelt = self.text[np.repeat(self.text_at[flat] - (spelt_end - long), long) + np.arange(int(spelt_end[-1]) if len(spelt_end) else 0)]
        spelt_at = np.concatenate((np.zeros(1, np.int64), spelt_end))[edge]
        for k in range(len(texts)):
            a, b = words.first[k], words.first[k + 1]
            g, m = gaps[a:b], min(n - 1, b - a)
            near = np.zeros(0, np.int64)
            if m:  # equal gaps: the earlier segments
                most = np.partition(g, m - 1)[m - 1]
                under = np.flatnonzero(g < most)
                near = np.sort(np.concatenate((under, np.flatnonzero(g == most)[: m - len(under)])))
            lists = [(int(p), self._list(int(slot[a + p]), n)) for p in near if g[p] < np.inf]
            same = not marked[k] and np.array_equal(spelt[spelt_at[k] : spelt_at[k + 1]], words.data[words.begin[k] : words.begin[k + 1]])
            yield flat[edge[k] : edge[k + 1]], _combine(float(total[k]), lists, n), float(total[k]), same

    def _list(self, slot: int, n: int) -> list[tuple[float, list[int]]]:
        if slot not in self.lists:
            self.lists[slot] = self.search(bytes(self.raw[self.begin[slot] : self.stop[slot]]), n)
        return self.lists[slot]


def _combine(total: float, lists: list[tuple[int, list[tuple[float, list[int]]]]], n: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
    """The ``n`` best choices of one segmentation for each listed segment."""
    out: list = [(0.0, ())]
    for place, options in lists:
        both = [(loss + options[0][0] - s, (*picks, (place, ids)) if k else picks) for loss, picks in out for k, (s, ids) in enumerate(options)]
        both.sort(key=lambda x: (x[0], [p for p, _ in x[1]]))
        out = both[:n]
    return [(total - loss, list(picks)) for loss, picks in out]


_made: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    kept = sys.modules[__name__].__dict__.setdefault("_made", {})
    if path not in kept:
        kept[path] = Lattice(path)
    return kept[path]


def segmentations(docs: DataFrame, n: int = 4, model: str | None = None, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_crc32, score, nbest_scores, n_changes
    (segments in which each of the N best differs from the best), round_trip[, ids]."""
    prepare(docs.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")
    names = ["doc_id", "n_pieces", "ids_crc32", "score", "nbest_scores", "n_changes", "round_trip"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.bool_()] + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(path)
        for batch in batches:
            texts = W.column(batch, "text")
            for a, b in W.slices(texts):
                part = texts.slice(a, b - a)
                cols: list[list] = [[] for _ in kinds]
                for ids, best, total, same in net.encode(part, n):
                    row = [len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, [s for s, _ in best], [len(c) for _, c in best], same] + [ids] * with_ids
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, n_changes array<int>, round_trip boolean" + ", ids array<long>" * with_ids)
