"""Toxicity scores that see through disguised spelling.

Noisy channel: a token that mixes letters with signs or digits, stretches a letter, or is
spelled out in single letters becomes a lattice of the letters each character may stand for
(or nothing, for fillers and repetitions).  Viterbi decoding under a character trigram model,
counted over all texts, restores the word; the score reads the restored text beside the plain.
A spelled-out run is read as a whole and from each of its letters on, as its first letter may
be a word of its own.

Score: a logistic model over words and word beginnings, told apart by how often a text has
them.  Features come from the labelled training rows (``SAMPLE`` rows at most, by a hash of
their id, a documented bound for the classifier): all whose rate differs between the labels by
``SURE`` standard errors or more; their weights are then fitted together.

Defined results: null is an empty text; a text without features, an empty one included, gets
the rate of such texts; without labels every score is 0.5; repeated rows are scored each;
rows with several labels count with each; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_sample, prepare

U = np.uint64
SAMPLE, SURE, LEVELS = 12_000, 2.5, 3
#: What a character may stand for, beside itself.
LEET = {"4": "a", "@": "a", "3": "e", "1": "il", "!": "i", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z", "(": "c", "*": "aeiou", "#": "aeiou"}
STAND, DROP, REPEAT, PAIR, SOME, ANY = 0.5, 0.5, 0.3, 3.0, 12.0, 2.5
PREFIXES = (4, 5, 6, 7, 8)
LETTERS = 28  # 0 is a word's edge, 1 to 26 the letters, 27 any other letter

_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_LETTER = _ASCII.copy()
_LETTER[0x80:] = True
_SOME = np.zeros(256, bool)
_SOME[[ord(c) for c in LEET]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "!*#|+("]] = True
_CODE = np.full(256, 27, np.int64)
_CODE[:128] = 0
_CODE[97:123] = np.arange(1, 27)


def _lower(words: W.Words) -> np.ndarray:
    """Bytes with the capitals of Latin-1 letters lower-cased too."""
    data = words.data
    at = np.flatnonzero(data == 0xC3)
    at = at[at + 1 < len(data)]
    nxt = data[at + 1]
    big = at[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
    data[big] += 32
    return data


def _letter_words(words: W.Words) -> W.Words:
    """Runs of letters within the words."""
    data = words.data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    edge = inside[1:] != inside[:-1]
    change = np.flatnonzero(edge)
    start, end = change[0::2], change[1::2]
    cut = words.begin[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    first = np.searchsorted(start, words.begin)
    return W.Words(data, start, end, np.repeat(np.arange(len(first) - 1), np.diff(first)), first, words.begin)


class CharacterModel:
    """Log probabilities of a letter after two others, from trigram counts."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(LETTERS, LETTERS, LETTERS) + 0.0
        two = n.sum(0)
        p2 = (two + 0.5) / (two.sum(1, keepdims=True) + 0.5 * LETTERS)
        self.cost = -np.log((n + 2 * p2[None]) / (n.sum(2, keepdims=True) + 2))

    def restore(self, token: str) -> str:
        """The likeliest word behind a token: the Viterbi path of its lattice."""
        beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before, token = "", token.rstrip("!*#|+(.,;:?\"'") or token  # closing signs stand for nothing
        for at, ch in enumerate(token):
            options: list[tuple[int, float]] = []
            if "a" <= ch <= "z":
                options.append((ord(ch) - 96, 0.0))
            elif ch > "\x7f":
                options.append((27, 0.0))
            stand = LEET.get(ch, "")
            options += [(ord(c) - 96, STAND if len(stand) < 3 else ANY) for c in stand]
            # fillers go at little cost, repetitions too once they are three; what may stand for a letter seldom
            if ch == before and options:
                drop = REPEAT if token[max(0, at - 2) : at + 3].count(ch) > 2 else PAIR
            else:
                drop = SOME if stand else None if options else DROP
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (c, s) in beam.items():
                if drop is not None and ((a, b) not in nxt or nxt[a, b][0] > c + drop):
                    nxt[a, b] = (c + drop, s)
                for letter, extra in options:
                    new = c + extra + self.cost[a, b, letter]
                    if (b, letter) not in nxt or nxt[b, letter][0] > new:
                        nxt[b, letter] = (new, s + (chr(96 + letter) if letter < 27 else ch))
            beam, before = nxt, ch
        return min((c + self.cost[a, b, 0], s) for (a, b), (c, s) in beam.items())[1]


def _ranges(mask: np.ndarray, words: W.Words) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask)))
    return total[words.end] - total[words.start]


def disguised(words: W.Words) -> tuple[list[str], np.ndarray]:
    """Tokens that may hide a word, and the text of each."""
    data, start, end = words.data, words.start, words.end
    if not len(start):
        return [], np.zeros(0, np.int64)
    ascii_, letter, some = _ASCII[data], _LETTER[data], _SOME[data]
    letters = _ranges(ascii_, words)
    # signs between the first and the last letter: as many letter runs as two or more
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    opens[start] = letter[start]
    runs = _ranges(opens, words)
    thrice = np.zeros(len(data), bool)
    thrice[2:] = ascii_[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    long_ = _ranges(thrice, words) > 0
    lead = some[start] & (end - start > 2) & ascii_[np.minimum(start + 1, len(data) - 1)]
    tail = some[end - 1] & (data[end - 1] < 58) & (data[end - 1] > 47) & letter[np.maximum(end - 2, 0)] & (end - start > 2)
    single = (end - start == 1) & (ascii_[start] | some[start])
    # few letters, and signs that stand for all the others: not only at the end, where a sign closes a sentence
    spelt = (letters >= 1) & (_ranges(letter | some, words) == end - start) & (_ranges(some & ~_CLOSING[data], words) > 0) & (end - start > 2)
    pick = (letters >= 2) & ((runs >= 2) | long_ | lead | tail) | spelt
    at = np.flatnonzero(pick)
    tokens, docs = [data[start[k] : end[k]].tobytes().decode("utf-8", "replace") for k in at], [words.doc[at]]
    # letters spelled out one by one
    same = np.zeros(len(start) + 1, bool)
    same[1:-1] = single[1:] & single[:-1] & (words.doc[1:] == words.doc[:-1])
    begin = np.flatnonzero(single & ~same[:-1])
    stop = np.flatnonzero(single & ~same[1:])
    for a, b in zip(begin[stop - begin >= 2].tolist(), stop[stop - begin >= 2].tolist(), strict=True):
        if ascii_[start[a : b + 1]].sum() >= 2:
            run = data[start[a : b + 1]].tobytes().decode("ascii")
            parts = [run] + [run[k : k + max(PREFIXES)] for k in range(1, len(run) - min(PREFIXES) + 1)]
            tokens += parts
            docs.append(np.repeat(words.doc[a : a + 1], len(parts)))
    return tokens, np.concatenate(docs)


def _features(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each occurrence of a word and of its beginnings."""
    runs = _letter_words(words)
    if not len(runs.start):
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = W._power(len(runs.data) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((runs.data.astype(U) + U(1)) * up[: len(runs.data)], dtype=U)))
    size = runs.end - runs.start
    h, doc = [W.mix((total[runs.end] - total[runs.start]) * down[runs.start] + U(99))], [runs.doc]
    for k in PREFIXES:
        at = np.flatnonzero(size >= k)
        s = runs.start[at]
        h.append(W.mix((total[s + k] - total[s]) * down[s] + U(k)))
        doc.append(runs.doc[at])
    return np.concatenate(h), np.concatenate(doc)


class Reader:
    """Feature occurrences of texts, plain and restored."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def _restored(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self.model.restore(token)
        return self.known[token]

    def read(self, texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, times) of each distinct feature of a text; ``keep``: only these hashes, sorted."""
        words = W.split(texts)
        data = _lower(words)
        words = words._replace(data=data)
        h, doc = _features(words)
        tokens, of = disguised(words)
        if tokens:
            hidden = pa.array([self._restored(t) for t in tokens], pa.string())
            h2, at = _features(W.split(hidden))
            h, doc = np.concatenate((h, h2)), np.concatenate((doc, of[at]))
        if keep is not None:
            low = np.zeros(1 << 16, bool)
            low[(keep & U(0xFFFF)).astype(np.int64)] = True
            at = np.flatnonzero(low[(h & U(0xFFFF)).astype(np.int64)])
            at = at[np.isin(h[at], keep)]
            h, doc = h[at], doc[at]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(new)
        return h[where], doc[where], np.diff(np.append(where, len(h)))


def _levels(h: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature that a text has n times counts at the levels 1 to n."""
    parts = [(W.mix(h + U(level)), doc, times) for level in range(LEVELS)]
    return np.concatenate([x[t > level] for level, (x, _, t) in enumerate(parts)]), np.concatenate([d[t > level] for level, (_, d, t) in enumerate(parts)])


def character_counts(texts: DataFrame) -> np.ndarray:
    """Counts of letter trigrams of all rows (text), word edges included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            column = W.column(batch, "text")
            for a, b in W.slices(column):
                words = W.split(column.slice(a, b - a))
                code = np.zeros(len(words.data) + 3, np.int64)
                code[2:-1] = _CODE[_lower(words)]
                tri = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
                tri[code[1:-1] == 0] = (tri % LETTERS)[code[1:-1] == 0]  # a word's first letter forgets the word before
                total += np.bincount(tri, minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(LETTERS**3)
    for r in texts.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # LETTERS ** 3 rows
        out[r.k] = r.n
    out[0] = 0
    return out


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, wide: int, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression over the ones (rows, cols) of a sparse matrix of ``wide`` columns, by
    Newton's method with conjugate gradients and backtracking."""
    n = len(y)
    rows, cols = np.concatenate((rows, np.arange(n))), np.concatenate((cols, np.full(n, wide)))
    w, pull = np.zeros(wide + 1), np.full(wide + 1, l2)
    pull[-1] = 1e-3

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[cols], n)

    def back(u: np.ndarray) -> np.ndarray:
        return np.bincount(cols, u[rows], wide + 1)

    def loss(w: np.ndarray) -> float:
        s = times(w)
        return float(np.logaddexp(0, s).sum() - s @ y + 0.5 * (pull * w * w).sum())

    for _ in range(30):
        p = 1 / (1 + np.exp(-times(w)))
        g, curve = back(p - y) + pull * w, p * (1 - p)
        ease = 1 / (back(curve) + pull)
        step, r = np.zeros_like(w), g.copy()
        d = ease * r
        rz = r @ d
        first = rz
        for _ in range(200):
            hd = back(curve * times(d)) + pull * d
            alpha = rz / (d @ hd)
            step += alpha * d
            r -= alpha * hd
            z = ease * r
            rz, old = r @ z, rz
            if rz <= 1e-16 * first:
                break
            d = z + rz / old * d
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = CharacterModel(character_counts(rows))
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    some = bounded_sample(marked.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held), F.struct("doc_id", "y"), SAMPLE)
    sample = rows.join(F.broadcast(some), "doc_id").select("text", "y")  # SAMPLE short rows at most are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            texts, y = W.column(batch, "text"), batch.column(1).to_numpy()
            for a, b in W.slices(texts):
                h, doc = _levels(*reader.read(texts.slice(a, b - a)))
                uniq, back = np.unique(h, return_inverse=True)
                t = np.bincount(back, y[a:b][doc], len(uniq)).astype(np.int64)
                n = np.bincount(back, minlength=len(uniq))
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(t), pa.array(n - t)], ["f", "t", "c"])

    distinct = sample.groupBy("y", F.md5("text").alias("h")).agg(F.first("text").alias("text")).select("text", "y")
    sizes = {r.y: r.n for r in distinct.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    weights, base, keep = np.zeros(0), 0.0, np.zeros(0, U)
    if len(sizes) == 2:
        nt, nc = float(sizes[1]), float(sizes[0])
        z = (F.col("t") / nt - F.col("c") / nc) / F.sqrt((F.col("t") + 1) / nt**2 + (F.col("c") + 1) / nc**2)
        told = distinct.mapInArrow(count, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t + c >= 4")
        best = told.withColumn("z", z).filter(F.abs("z") > SURE).select("f").collect()  # features of SAMPLE rows, few of which differ so much
        keep = np.sort(np.array([r.f for r in best], np.int64).view(U))

        def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(model)
            for batch in batches:
                texts, y = W.column(batch, "text"), batch.column(1)
                for a, b in W.slices(texts):
                    h, doc = _levels(*reader.read(texts.slice(a, b - a)))
                    hit = np.isin(h, keep)
                    h, doc = h[hit], doc[hit]
                    order = np.argsort(doc, kind="stable")
                    cut = np.searchsorted(doc[order], np.arange(b - a + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([y.slice(a, b - a), pa.ListArray.from_arrays(cut, pa.array(np.searchsorted(keep, h[order]).astype(np.int32)))], ["y", "at"])

        fit = distinct.mapInArrow(present, "y int, at array<int>").collect()  # SAMPLE rows of numbers
        fit = sorted((r.y, sorted(r.at)) for r in fit)  # the same sums in any order of rows
        cols = np.array([c for _, at in fit for c in at], np.int64)
        weights, base = _fit(np.repeat(np.arange(len(fit)), [len(at) for _, at in fit]), cols, np.array([y for y, _ in fit], float), len(keep))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            texts = W.column(batch, "text")
            for a, b in W.slices(texts):
                s = np.full(b - a, base)
                if len(keep):
                    h, doc = _levels(*reader.read(texts.slice(a, b - a)))
                    at = np.minimum(np.searchsorted(keep, h), len(keep) - 1)
                    hit = keep[at] == h
                    s += np.bincount(doc[hit], weights[at[hit]], b - a)
                p = np.round(1 / (1 + np.exp(-s)), 12)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
