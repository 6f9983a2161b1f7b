"""Periodic runs: stretches of words that repeat with one period, and texts without the repeats.

A run of period q is a stretch of at least ``max(least, times * q)`` words in which words q apart
are the same, that no neighbouring word extends, and q is its smallest period.  Of a text of n
words every period p up to ``n / times`` is looked at on a grid: the places where words p apart
agree make up at least ``max(least - p, (times - 1) * p)`` places in a row, so a grid of that step
cannot miss them, and all grids together have about ``n * log(n) / 2`` points.  One numpy pass
takes a slab of (period, point) pairs at once: the words at the pair, then one prefix-hash
comparison of half a step to each side, then a binary search of both common extensions.  What is
found is verified on the words' numbers (equal numbers are equal words); where hashes lied, the
slab is done again by comparing words.  Multiples of a period give the same stretch, of which the
smallest stays.

Texts are worked on alone, inside tasks, with nothing shuffled; memory is a few arrays of a
text's length and of ``SLAB`` pairs.

Defined results: null and blank texts have no words, no runs and an empty collapsed text; a very
long text is taken whole; equal runs of repeated rows are reported for each row; two runs of one
stretch cannot tie, since the smallest period stays; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .words import BASE, U, column, mix, slices

#: Pairs of a period and a grid point that are worked on at a time.
SLAB = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number; equal numbers are equal words."""
    known: defaultdict = defaultdict(itertools.count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def grid(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(period, point, step of the period's grid) of all pairs, in slabs."""
    period = np.arange(1, n // times + 1)
    step = np.maximum(least - period, (times - 1) * period)
    points = -(-(n - period) // step)
    upto = np.cumsum(points)
    at = 0
    while at < len(period):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLAB, "right")))
        k = np.repeat(np.arange(at, to), points[at:to])
        first = np.repeat(upto[at:to] - points[at:to], points[at:to])
        place = np.arange(len(k)) + (upto[at] - points[at]) - first
        yield period[k], place * step[k], step[k]
        at = to


class Prefixes:
    """Prefix hashes of a text's words: whether two stretches are equal, for many at once."""

    def __init__(self, ids: np.ndarray):
        self.power = np.cumprod(np.concatenate((np.ones(1, U), np.full(len(ids), BASE, U))), dtype=U)
        self.total = np.concatenate((np.zeros(1, U), np.cumsum(mix(ids.astype(U) + U(1)) * self.power[:-1], dtype=U)))

    def same(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` are those from ``at + apart``, by hash."""
        t = self.total
        return (t[at + length] - t[at]) * self.power[apart] == t[at + apart + length] - t[at + apart]

    def extend(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far equality goes from ``at`` on, or back from before it: one binary search for all pairs."""
        low, high = np.zeros_like(most), most
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.same(at - middle if back else at, apart, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def _by_words(ids: np.ndarray, period: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch around each pair, found without hashes."""
    start, end = np.zeros_like(point), np.zeros_like(point)
    for p in np.unique(period):
        mine = np.flatnonzero(period == p)
        ends = np.concatenate(([-1], np.flatnonzero(ids[:-p] != ids[p:]), [len(ids) - p]))
        k = np.searchsorted(ends, point[mine])
        start[mine], end[mine] = ends[k - 1] + 1, ends[k] + p
    return start, end


def find_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start and period."""
    n, found = len(ids), {}
    if times < 2 or least < 1:
        raise ValueError("runs are at least one word and two periods long")
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    table = Prefixes(ids)
    for period, point, step in grid(n, least, times):
        hit = np.flatnonzero(ids[point] == ids[point + period])
        period, point, half = period[hit], point[hit], (step[hit] + 1) // 2
        ahead = point + period + half <= n
        ahead[ahead] = table.same(point[ahead], period[ahead], half[ahead])
        behind = ~ahead & (point >= half)
        behind[behind] = table.same(point[behind] - half[behind], period[behind], half[behind])
        hit = np.flatnonzero(ahead | behind)
        if not len(hit):
            continue
        period, point = period[hit], point[hit]
        start = point - table.extend(point, period, point, True)
        end = point + period + table.extend(point, period, n - point - period, False)
        for exact in (False, True):
            if exact:
                start, end = _by_words(ids, period, point)
            long = np.flatnonzero(end - start >= np.maximum(least, times * period))
            rows = long[np.lexsort((period[long], end[long], start[long]))]
            s, e, p = start[rows], end[rows], period[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
            held = list(zip(s[new].tolist(), e[new].tolist(), p[new].tolist(), strict=True))
            if all(np.array_equal(ids[a : b - q], ids[a + q : b]) for a, b, q in held if found.get((a, b), n) > q):
                break
        for a, b, q in held:
            found[a, b] = min(q, found.get((a, b), q))
    return np.array(sorted((a, b - a, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


def repeats_of(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, runs (start, length, period; word numbers) and the
    collapsed text: the words that no run repeats, joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for a, b in slices(texts):
                counts, all_runs, kept = [], [], []
                for whole in texts.slice(a, b - a).to_pylist():
                    words = whole.encode().split()
                    counts.append(len(words))
                    runs = find_runs(numbered(words), least, times)
                    if len(runs):
                        words = list(itertools.compress(words, ~repeats_of(runs, len(words))))
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shape = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(trimmed(work), shape)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties to the least start, then period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, none, better)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the texts, those of every tenth key, by the checksum of its decimal form, with
    their words made periodic from some word on.  The words are a column of their own, split once."""
    h = F.crc32(F.col("key").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", "text", words.alias("words"))
    g, n = F.floor(h / 10), F.size("words")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # the places of the words, so that no lambda holds more than numbers and the column
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    rows = rows.select("key", "text", "words", n.alias("n"), a.alias("a"), p.alias("p"))
    made = F.array_join(F.transform(places, lambda i: F.get("words", i)), " ")
    return rows.select("key", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
