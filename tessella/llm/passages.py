"""Substring dedup: passages that repeat, exactly or nearly, across documents.

Compact windows (Peng, Wang and Deng, SIGMOD 2023): under one hash function, every stretch of
a text that is long enough has one least element; stretches with the same one form a window
(left, least position, right), a node of the Cartesian tree over the hashes.  The elements are
runs of ``GRAM`` words and a window has ``WIDE`` of them, so two texts that share ``GRAM + WIDE - 1``
= 25 words in a row share a window's hash for certain.  A passage of 50 words or more at 0.8
always has such a run: a gap parts nine shingles of both texts at least, so k gaps need 36 k
common shingles, in k + 1 runs; with one gap, 41 of the 46 shingles are common, 21 in one run.

Plan: the least elements come from one scan.  Equal texts are told by digest: a copy meets its
first copy and nothing else.  Every other holder of a window meets the window's first holder, a
star, when they share more than one; the texts of these pairs are verified on all their
shingles.  Where a holder's place lies in no passage found so far, the first holder did not have
what others may have.  All holders of such a window then say the stretches of ``least`` words
around the place, by three keys: the whole stretch, and its first and last shingle with one of
two between.  Any stretch that is equal shares the first key, one with a single edit one of the
others, and the first holders of these keys are verified too.  All steps are linear in the
places; a stretch that is equal is never missed, as the first holder of its key has it.

Defined results: a row (doc_id, source_id, ...) for each passage of ``doc_id`` that an earlier
document (smaller id) has, so the first holder of a passage stays clean; repeats within one
text do not count; null texts, blank texts and texts of fewer than ``least`` words have no
passage; rows without an id take no part; repeated rows count once; an empty table gives no
rows; further columns, whatever their names, are ignored (``drop_repeats`` returns them as they
are).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare, stash, sweep, trimmed

U = np.uint64
SHINGLE = 5
#: Shingles that a single edit may part.
GAP = 2 * SHINGLE
#: Words of a window's elements, and elements of a window.
GRAM, WIDE = 16, 10
FIELDS = "doc_id long, source_id long, start int, end int, source_start int, source_end int, n_words int, similarity double, digest string"


def _minima(a: np.ndarray, widest: int) -> list[np.ndarray]:
    """Least of every stretch of 1, 2, 4, ... elements, by its start."""
    out = [a]
    while 2 << (len(out) - 1) <= widest:
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def compact_windows(a: np.ndarray, t: int, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, left, right) of each window of ``t`` or more elements of ``a``, whose texts,
    of ``widest`` elements at most, are parted by zeros; among equal least elements the first
    counts."""
    low = _minima(a, widest)
    j = min(t.bit_length() - 1, len(low) - 1)
    if len(a) < t or 1 << j > t:
        return (np.zeros(0, np.int64),) * 3
    # the least of each stretch of t; a position is a candidate when it is the least of one
    v = np.minimum(low[j][: len(a) - t + 1], low[j][t - (1 << j) :][: len(a) - t + 1])
    most = np.concatenate((np.zeros(t - 1, U), v, np.zeros(t - 1, U)))
    width = 1
    while width < t:
        step = min(width, t - width)
        most = np.maximum(most[:-step], most[step:])
        width += step
    c = np.flatnonzero((most == a) & (a > 0))
    left, right, own = c.copy(), c + 1, a[c]
    for j in range(len(low) - 1, -1, -1):
        n = 1 << j
        at = left - n
        ok = at >= 0
        ok[ok] = low[j][at[ok]] > own[ok]
        left[ok] -= n
        ok = right < len(low[j])
        ok[ok] = low[j][right[ok]] >= own[ok]
        right[ok] += n
    keep = right - left >= t
    return c[keep], left[keep], right[keep]


def windows(docs: DataFrame, least: int) -> DataFrame:
    """(bucket, node, tag, c) of the documents (doc_id, tag, text): the word at which a window's least element begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), W.column(batch, "text")
            for a, b in W.slices(texts):
                words = W.split(texts.slice(a, b - a))
                h = words.hashes()
                many = np.diff(words.first)
                if not len(h) or many.max() < least:
                    continue
                sh, doc = W.shingles(words, GRAM, h)
                use = many[doc] >= least
                sh, doc = sh[use], doc[use]
                first = np.searchsorted(doc, np.arange(b - a))
                place = np.arange(len(doc)) + doc - doc[0] + 1  # a gap of one or more before each text
                x = np.zeros(int(place[-1]) + 2, U)
                own = np.zeros(len(x), np.int64)
                own[place] = np.arange(len(doc))
                x[place] = W.mix(sh) | U(1)
                c = compact_windows(x, WIDE, int(many.max()))[0]
                bucket, d = x[c], doc[own[c]]
                at = own[c] - first[d]
                # a text that repeats itself within a gap: one row for each stretch
                order = np.lexsort((at, bucket, d))
                same = np.zeros(len(order), bool)
                same[1:] = (d[order][1:] == d[order][:-1]) & (bucket[order][1:] == bucket[order][:-1]) & (at[order][1:] // SHINGLE == at[order][:-1] // SHINGLE)
                order = order[~same]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order].view(np.int64)), pa.array(keys[a:b][d[order]], pa.int64()), pa.array(tags[a:b][d[order]], pa.int64()), pa.array(at[order].astype(np.int32))],
                    ["bucket", "node", "tag", "c"],
                )

    return docs.select("doc_id", "tag", "text").mapInArrow(trimmed(run), "bucket long, node long, tag long, c int")


def stretches(holders: DataFrame, least: int) -> DataFrame:
    """(k, node, held, at) of rows (node, text, w), w the places of shared windows: keys of each
    stretch of ``least`` words around a place; ``at`` is its first word, and less than 0 for
    the key of the whole stretch.

    A middle shingle counts from the stretch's start or from its end, so that one edit spares
    one of the two.  Stretches one word shorter or longer only ask (``held`` is false): that
    is how a text with a word put in or left out meets the other.
    """
    far, mid = least - SHINGLE, (least - SHINGLE) // 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, w = W.column(batch, "text"), batch.column(2)
            ends = w.offsets.to_numpy()
            places = w.values.to_numpy(zero_copy_only=False)
            for a, b in W.slices(texts):
                words = W.split(texts.slice(a, b - a))
                sh, doc = W.shingles(words, SHINGLE)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                at = places[ends[a] : ends[b]] + np.repeat(first[:-1], np.diff(ends[a : b + 1]))
                own = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                # stretches from least - GRAM shingles before a place on
                step = np.zeros(len(sh) + 1, np.int64)
                np.add.at(step, np.maximum(at - (least - GRAM), first[:-1][own]), 1)
                np.add.at(step, np.minimum(at + 1, len(sh)), -1)
                i = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                keys, nodes, held, place = [], [], [], []
                for wide in (far, far - 1, far + 1):
                    k = i[i + wide < first[1:][doc[i]]]
                    ends_of = W.mix(sh[k] * U(W.BASE) + sh[k + wide])
                    parts = [W.mix(ends_of + sh[k + mid] * U(3)), W.mix(ends_of + sh[k + wide - mid] * U(5))]
                    if wide == far:
                        up, down = W._power(len(sh) + 1)
                        total = np.concatenate((np.zeros(1, U), np.cumsum(sh * up[: len(sh)], dtype=U)))
                        parts.append(W.mix((total[k + far + 1] - total[k]) * down[k] + U(7)))
                    keys += parts
                    nodes += [doc[k]] * len(parts)
                    held += [np.full(len(k), wide == far)] * len(parts)
                    at = (k - first[doc[k]]).astype(np.int32)
                    place += [at, at] + [~at] * (wide == far)
                key, node, is_held, at = np.concatenate(keys), np.concatenate(nodes), np.concatenate(held), np.concatenate(place)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(node)), pa.array(is_held), pa.array(at)], ["k", "node", "held", "at"])

    return holders.select("node", "text", "w").mapInArrow(trimmed(run), "k long, node long, held boolean, at int")


class _Text:
    """A text's words, shingles and places."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, sh: np.ndarray):
        self.data, self.start, self.end, self.sh = data, start, end, sh

    @cached_property
    def points(self) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.int64), np.cumsum((self.data & 0xC0) != 0x80)))

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.sh, kind="stable")

    @cached_property
    def sorted(self) -> np.ndarray:
        return self.sh[self.order]

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Code points of the words of shingles a to b."""
        return int(self.points[self.start[a]]), int(self.points[self.end[min(b + SHINGLE - 1, len(self.end) - 1)]])


def _texts(column: pa.Array) -> Iterator[_Text]:
    """The texts of a column without nulls, split and shingled together."""
    for a, b in W.slices(column):
        words = W.split(column.slice(a, b - a))
        sh, doc = W.shingles(words, SHINGLE)
        edge = np.searchsorted(doc, np.arange(b - a + 1))
        for k in range(b - a):
            lo, hi, at = words.first[k], words.first[k + 1], words.begin[k]
            yield _Text(words.data[at : words.begin[k + 1]], words.start[lo:hi] - at, words.end[lo:hi] - at, sh[edge[k] : edge[k + 1]])


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning; x and y are compared by growing stretches."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = x[at : at + step] != y[at : min(n, at + step)] if at + step <= n else x[at:n] != y[at:n]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, step * 4
    return n


def _similar(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _runs(x: _Text, y: _Text) -> list[tuple[int, int, int, int]]:
    """(place in x, place in y, shingles, shingles that also agree before) of the runs that x and y share, from left to right: at
    each place of x the longest run from any place in y, ties to the one that goes on best."""
    lo = np.searchsorted(y.sorted, x.sh, "left")
    hits = np.flatnonzero(y.sorted[np.minimum(lo, len(y.sorted) - 1)] == x.sh)
    out: list[tuple[int, int, int, int]] = []
    at, drift = 0, 0
    while at < len(hits):
        i = int(hits[at])
        hi = int(np.searchsorted(y.sorted, x.sh[i], "right"))
        best, n = -1, 0
        for j in y.order[lo[i] : hi].tolist():
            # a place that cannot be longer is not compared in full
            if n and (j + n > len(y.sh) or i + n > len(x.sh) or y.sh[j + n - 1] != x.sh[i + n - 1]):
                continue
            m = _alike(x.sh[i:], y.sh[j:])
            if m > n or (m == n and abs(j - i - drift) < abs(best - i - drift)):
                best, n = j, m
        back = _alike(x.sh[:i][::-1], y.sh[:best][::-1])
        out.append((i, best, n, back))
        drift = best - i
        at = int(np.searchsorted(hits, i + n))
    return out


def passages(x: _Text, y: _Text, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages (first and last shingle in x and in y, similarity).

    Runs of shingles that follow each other in both texts are the seeds.  From left to right
    a run joins the passage before it while the whole stays similar enough.  A run that is a
    passage by itself counts from where it begins, also when the run before reaches into it.
    """
    if not len(y.sh) or not len(x.sh):
        return []
    runs = _runs(x, y)
    out: list[tuple[int, int, int, int, float]] = []
    now: list[int] | None = None  # x from, x to, y from, y to, shingles matched

    def flush() -> None:
        if now and now[1] - now[0] + SHINGLE >= least:
            s = _similar(x.sh[now[0] : now[1] + 1], y.sh[now[2] : now[3] + 1])
            if 100 * s >= percent:
                out.append((now[0], now[1], now[2], now[3], s))

    for i, j, n, back in runs:
        run = [i, i + n - 1, j, j + n - 1, n]
        if now:
            both = [now[0], run[1], min(now[2], run[2]), max(now[3], run[3]), now[4] + run[4]]
            wide = both[1] - both[0] + 1 + max(both[3] - both[2] + 1, both[4]) - both[4]
            if run[0] - now[1] <= 3 * GAP and 100 * both[4] >= percent * wide:
                now = both
                continue
            if run[4] < now[4] and run[0] - now[1] <= GAP and run[4] <= SHINGLE:
                continue  # a stray shingle does not end a passage
            flush()
        now = [i - back, run[1], j - back, run[3], n + back]
    flush()
    for i, j, n, back in runs:
        if n + back + SHINGLE - 1 >= least and not any(a <= i - back and i + n - 1 <= b for a, b, *_ in out):
            out.append((i - back, i + n - 1, j - back, j + n - 1, 1.0))
    return out


def _verified(pairs: DataFrame, rows: DataFrame, least: int, percent: int) -> DataFrame:
    """``FIELDS`` and tag, a, b (of the text of doc_id, in shingles) of the pairs (node, hub) with hub < node."""
    # two joins with the same table: its exchange by doc_id is written once and read twice
    texts = rows.select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("node"), F.col("text").alias("x")), "node").join(texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("y")), "hub").select("node", "hub", F.xxhash64("x").alias("tag"), "x", "y", F.md5("x").alias("xh"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            out: list[tuple] = []
            node, hub, tag, xh = (batch.column(c).to_pylist() for c in (0, 1, 2, 5))
            hubs = pc.run_end_encode(batch.column(4))  # a hub's rows follow each other
            own = np.searchsorted(hubs.run_ends.to_numpy(), np.arange(batch.num_rows), "right")
            ys = _texts(hubs.values)
            at = -1
            for k, x in enumerate(_texts(batch.column(3))):
                if own[k] != at:
                    at, y = own[k], next(ys)
                    if held[0] is not None and np.array_equal(held[0], y.data):
                        y = held[1]
                    held = (y.data, y)
                y = held[1]
                if np.array_equal(x.data, y.data):
                    n = len(y.start)
                    found = [(0, n - SHINGLE, 0, n - SHINGLE, 1.0)] if n >= least else []
                else:
                    found = passages(x, y, least, percent)
                for a, b, c, d, sim in found:
                    out.append((node[k], hub[k], *x.span(a, b), *y.span(c, d), b - a + SHINGLE, sim, xh[k], tag[k], a, b))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "source_id", "start", "end", "source_start", "source_end", "n_words", "similarity", "digest", "tag", "a", "b"])

    return both.mapInArrow(trimmed(run), FIELDS + ", tag long, a int, b int")


def _repeats(docs: DataFrame, least: int, percent: int, key: str, text: str) -> DataFrame:
    """Rows of ``FIELDS``: digest is that of the text of doc_id, as rows may share an id."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("tag", F.xxhash64("text"))
    found = stash(windows(rows, least))
    hubs = found.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").drop("last")
    hubs = stash(hubs)  # a plain table: the join's hot keys can be split
    digests = rows.select("doc_id", "tag", F.unhex(F.md5("text")).alias("h"))
    firsts = digests.groupBy("h").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").drop("last")
    copies = stash(digests.join(firsts, "h").filter("hub < doc_id").select(F.col("doc_id").alias("node"), "tag", "hub").distinct())
    met = stash(found.join(hubs, "bucket").join(copies.select("node", "tag"), ["node", "tag"], "left_anti").distinct())
    sweep(spark, found, hubs)
    stars = met.filter("hub < node")
    likely = stash(stars.groupBy("node", "hub").agg(F.min("bucket").alias("x"), F.max("bucket").alias("y")).filter("x < y").select("node", "hub").union(copies.select("node", "hub")).distinct())
    first = stash(_verified(likely, rows, least, percent))
    sweep(spark)
    # holders of windows with places in no passage yet
    done = first.select(F.col("doc_id").alias("node"), "tag", "a", "b").distinct()
    opened = stars.join(done, (stars["node"] == done["node"]) & (stars["tag"] == done["tag"]) & (stars["c"] >= done["a"]) & (stars["c"] + GRAM - SHINGLE <= done["b"]), "left_anti").groupBy("bucket").agg(F.max("node").alias("last"))
    opened = stash(opened)
    holders = met.join(opened, "bucket").filter("node <= last").groupBy("node", "tag").agg(F.collect_set("c").alias("w"))
    keys = stash(stretches(holders.join(rows.withColumnRenamed("doc_id", "node"), ["node", "tag"]), least))
    sweep(spark, met, opened)
    shared = keys.groupBy("k").agg(F.min(F.when(F.col("held"), F.col("node"))).alias("hub"), F.min("node").alias("x"), F.max("node").alias("y")).filter("hub is not null and x < y").select("k", "hub")
    shared = stash(shared)
    sweep(spark)
    met = keys.join(shared, "k").filter("hub != node").withColumn("w", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")))
    # where a whole stretch has an earlier holder, that one is enough
    by_place = met.groupBy("node", "w").agg(F.min(F.when((F.col("at") < 0) & (F.col("hub") < F.col("node")), F.col("hub"))).alias("sure"), F.collect_set("hub").alias("hubs"))
    hubs = F.explode(F.when(F.col("sure").isNotNull(), F.array("sure")).otherwise(F.col("hubs")))  # six keys have six hubs at most
    more = by_place.select("node", hubs.alias("hub")).select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).distinct()
    more = stash(more.join(likely, ["node", "hub"], "left_anti"))
    sweep(spark, keys, shared, likely, copies)
    return first.union(_verified(more, rows, least, percent)).drop("tag", "a", "b").distinct()


def repeats(docs: DataFrame, least: int = 50, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, source_id, start, end, source_start, source_end (code points), n_words, similarity."""
    return _repeats(docs, least, percent, key, text).drop("digest")


def drop_repeats(docs: DataFrame, least: int = 50, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages that earlier documents have; a text of which nothing is
    left goes, all others stay, with their columns."""
    spans = _repeats(docs, least, percent, key, text)
    lists = spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut"))
    body = F.col("body")
    kept = F.aggregate(
        "cut",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] <= acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    # the row travels as one struct, so none of its names can clash
    at = docs.columns.index(text)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if k != at]).alias("row")
    named = docs.select(row, F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"), F.md5(F.col(f"`{text}`").cast("string")).alias("digest"))
    joined = named.join(lists, ["doc_id", "digest"], "left").select("row", "cut", F.when(F.col("cut").isNull(), body).otherwise(kept).alias("body"))
    kept_rows = joined.filter(F.col("cut").isNull() | (F.trim("body") != ""))
    return kept_rows.select(*[F.col("body" if k == at else f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
