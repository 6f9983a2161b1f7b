"""Language-model scores of whole documents by a gated recurrent network, in numpy.

Words and one end per text are the tokens.  Every distinct word of the training fold is
counted (a shuffle that grows with the corpus).  The network predicts one of a fixed number
of units: the commonest words, and classes of rarer words by ending; a rarer word then has
its share of its class by the corpus's counts, unseen words sharing half a count per class,
so the score is a probability of the very text.  Output is factored into classes of units.
Training is by truncated backpropagation over windows with the state carried on; scoring
carries the state from a text's first word to its last, all texts of a batch in step.

Bounds: the network's size, and the table of common words that tasks hold (``HEAD`` entries).
Counts of words beyond it come by a join on the word, which has no common word left in it and
so no hot key.  All tokens of the training fold train the weights: texts are dealt by a hash to
one trainer for each ``TRAIN_TASK`` tokens, which reads them as a stream in a fixed order; the
trainers' weights are averaged in a tree of ``FAN`` at a time.  Neither depends on how the
table is partitioned; sums of 32-bit numbers may differ in their last digits.

Defined results: null is an empty text (one end); an empty training fold leaves uniform
weights and counts of 0; repeated rows are scored each; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import commonest, prepare, stash, trimmed

U = np.uint64
#: Common words whose counts tasks hold.
HEAD = 1 << 19
#: Units of the network: common words and classes of rarer words; classes of units; state size.
UNITS, RARE, CLASSES, STATE = 4096, 256, 64, 16
WIDE = UNITS // CLASSES
ONES = np.ones(WIDE, np.float32)
#: Tokens that one trainer learns from; tokens it holds at a time; most texts side by side; weights averaged at a time.
TRAIN_TASK, BUFFER, LANES, FAN = 4_000_000, 1 << 17, 256, 64
#: Tokens that a task scores in step.
CHUNK = 1_500_000
END = 0x5851F42D4C957F2D


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rare classes of all tokens, each text's end included, and each text's first."""
    words = W.split(texts)
    h = words.hashes()
    n = len(words.start)
    last = words.data[words.end - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)].astype(np.int64), 0) if n else last
    rare = (last * 31 + before * 7 + np.minimum(words.end - words.start, 12) // 4 * 101) % RARE
    first = words.first[1:]
    return np.insert(h, first, U(END)), np.insert(rare, first, 0), np.concatenate((np.zeros(1, np.int64), first + np.arange(1, len(first) + 1)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, rare) of every distinct token of the rows (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n, rare = (np.concatenate(x) for x in zip(*held, strict=True))
            uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(back, n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(total), pa.array(rare[first].astype(np.int32))], ["word", "n", "rare"])

        for batch in batches:
            texts = W.column(batch, "text")
            for a, b in W.slices(texts):
                h, rare, _ = _tokens(texts.slice(a, b - a))
                one, back = W.index(h)
                held.append((h[one], np.bincount(back), rare[one]))
                size += len(one)
                if size > 1_500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(trimmed(run), "word long, n long, rare int").groupBy("word").agg(F.sum("n").alias("n"), F.min("rare").alias("rare"))


class Vocabulary(NamedTuple):
    """What every task holds of the counts: bounded by HEAD."""

    words: np.ndarray  # hashes, ascending
    counts: np.ndarray
    units: np.ndarray  # of the commonest words, else -1
    mass: np.ndarray  # (c + 0.5) of each class of rarer words, and 0.5 for unseen ones
    start: np.ndarray  # tokens of each unit, for the first biases

    def look(self, h: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit and count of each token; count -1 where the table has no such word."""
        if not len(self.words):
            return (UNITS - RARE + rare).astype(np.int32), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        unit = np.where(hit, self.units[at], -1)
        return np.where(unit >= 0, unit, UNITS - RARE + rare).astype(np.int32), np.where(hit, self.counts[at], -1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    head = commonest(counts, "n", HEAD).toArrow()
    h, n = head["word"].to_numpy().view(U), head["n"].to_numpy()
    order = np.lexsort((h, -n))
    unit = np.full(len(h), -1, np.int64)
    unit[order[: UNITS - RARE]] = np.arange(min(len(h), UNITS - RARE))
    start = np.zeros(UNITS)
    start[unit[unit >= 0]] = n[unit >= 0]
    mass = np.full(RARE, 0.5)
    rows = counts.groupBy("rare").agg(F.sum(F.col("n") + 0.5).alias("m"), F.sum("n").alias("n")).collect()  # RARE rows
    for r in rows:
        mass[r.rare] += r.m
        start[UNITS - RARE + r.rare] += r.n
    own = head["rare"].to_numpy()
    np.subtract.at(mass, own[unit >= 0], n[unit >= 0] + 0.5)
    np.subtract.at(start, UNITS - RARE + own[unit >= 0], n[unit >= 0])
    sort = np.argsort(h)
    return Vocabulary(h[sort], n[sort], unit[sort], np.maximum(mass, 0.5), np.maximum(start, 0))


class Network:
    """Weights in one flat vector, and its parts as views."""

    SHAPES = {"x": (UNITS, 3 * STATE), "u": (STATE, 3 * STATE), "b": (3 * STATE,), "wc": (STATE, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, STATE, WIDE), "bw": (CLASSES, WIDE)}

    def __init__(self, flat: np.ndarray | None = None):
        self.flat = np.zeros(sum(int(np.prod(s)) for s in self.SHAPES.values()), np.float32) if flat is None else flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, start: np.ndarray) -> Network:
        net, rng = cls(), np.random.default_rng(7)
        net.x[:] = rng.normal(0, 0.3, net.x.shape)
        net.u[:] = rng.normal(0, 0.25, net.u.shape)
        net.wc[:] = rng.normal(0, 0.05, net.wc.shape)
        net.ww[:] = rng.normal(0, 0.05, net.ww.shape)
        p = (start + 0.5).reshape(WIDE, CLASSES).T  # unit = place * CLASSES + class
        net.bc[:] = np.log(p.sum(1) / p.sum())
        net.bw[:] = np.log(p / p.sum(1, keepdims=True))
        return net

    def gates(self, h: np.ndarray, x: np.ndarray) -> tuple:
        """Next state and what backpropagation needs, ``x`` the inputs with their biases.

        Both functions by ``exp``, which numpy has faster than ``tanh``: where it is infinite they are 0 or 1.
        """
        g = h @ self.u
        zr = x[:, : 2 * STATE] + g[:, : 2 * STATE]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :STATE], zr[:, STATE:]
        gc = g[:, 2 * STATE :]
        c = r * gc
        c += x[:, 2 * STATE :]
        c += c
        np.exp(c, out=c)
        c += 1
        np.divide(-2, c, out=c)
        c += 1
        new = h - c
        new *= z
        new += c
        return new, z, r, gc, c

    def logits(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of each class's units, their biases as a last row."""
        return np.concatenate((self.wc, self.bc[None])), np.concatenate((self.ww, self.bw[:, None]), 1)

    def log_probability(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Of each unit after its state; units of a class share one product of matrices."""
        order, cls, place, edge, h = by_class(h, unit)
        rows, (wc, ww) = np.arange(len(h)), self.logits()
        s = h @ wc
        out = s[rows, cls]
        out -= np.log(np.exp(s, out=s) @ ONES)
        for k in range(CLASSES):
            a, b = edge[k], edge[k + 1]
            if a < b:
                s = h[a:b] @ ww[k]
                out[a:b] += s[rows[: b - a], place[a:b]]
                out[a:b] -= np.log(np.exp(s, out=s) @ ONES)
        back = np.empty_like(out)
        back[order] = out
        return back


def by_class(h: np.ndarray, unit: np.ndarray) -> tuple:
    """(order by class; in that order classes, places, each class's first, states with a 1 for the bias)."""
    cls = (unit % CLASSES).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cls, place = cls[order], unit[order] // CLASSES
    wide = np.ones((len(h), STATE + 1), np.float32)
    wide[:, :STATE] = h.take(order, 0)
    return order, cls, place, np.searchsorted(cls, np.arange(CLASSES + 1)).tolist(), wide


def less_told(p: np.ndarray, told: np.ndarray) -> None:
    """Rows of logits to their softmax less 1 at what is told, in place."""
    np.exp(p, out=p)
    p *= (1 / (p @ ONES))[:, None]
    p.reshape(-1)[np.arange(len(p)) * p.shape[1] + told] -= 1


class Trainer:
    """Truncated backpropagation over a stream of texts (Adagrad steps).

    Tokens are gathered until ``BUFFER`` of them fill ``lanes`` rows side by side; windows of
    the rows are learned from left to right, with the state carried from window to window and
    cleared where a text begins.  What is held is bounded, whatever the stream's length.
    """

    def __init__(self, net: Network, lanes: int, window: int = 16, rate: float = 0.05):
        self.net, self.lanes, self.window, self.rate = net, lanes, window, rate
        self.seen = np.full(len(net.flat), 1e-3, np.float32)
        self.grad = Network()
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0

    def add(self, units: np.ndarray, fresh: np.ndarray) -> None:
        """Tokens of texts, and where texts begin."""
        self.waiting.append(np.stack((units, fresh)).astype(np.int32))
        self.held += len(units)
        self.tokens += len(units)
        if self.held >= BUFFER:
            flow = np.concatenate(self.waiting, 1)
            for k in range(0, self.held - BUFFER + 1, BUFFER):
                self._learn(flow[:, k : k + BUFFER])
            self.waiting = [flow[:, self.held - self.held % BUFFER :]]
            self.held %= BUFFER

    def finish(self) -> None:
        if self.held:
            self._learn(np.concatenate(self.waiting, 1))
        self.waiting, self.held = [], 0

    def _learn(self, flow: np.ndarray) -> None:
        n = flow.shape[1]
        lanes = max(1, min(self.lanes, n // self.window))
        whole = n // lanes * lanes
        units, fresh = (x[:whole].reshape(lanes, -1).T for x in flow)  # (steps, lanes)
        state = np.zeros((lanes, STATE), np.float32)
        for t in range(0, len(units), self.window):
            state = self.window_step(np.ascontiguousarray(units[t : t + self.window]), fresh[t : t + self.window] == 0, state)
        if whole < n:
            self.window_step(np.ascontiguousarray(flow[0, whole:, None]), flow[1, whole:, None] == 0, np.zeros((1, STATE), np.float32))

    @np.errstate(over="ignore")
    def gradient(self, units: np.ndarray, goes_on: np.ndarray, state: np.ndarray) -> tuple:
        """(gradient, rows of ``x`` it touches and theirs, the last state) of the loss of a window (steps, lanes)."""
        net, (n, lanes) = self.net, units.shape
        grad = self.grad  # its embedding is not used
        keep = goes_on.astype(np.float32)[:, :, None]
        x = net.x.take(units, 0)
        x += net.b
        before = np.empty((n, lanes, STATE), np.float32)
        z, r, gc, c = (np.empty_like(before) for _ in range(4))
        for t in range(n):
            np.multiply(state, keep[t], out=before[t])
            state, z[t], r[t], gc[t], c[t] = net.gates(before[t], x[t])
        unit = units.reshape(-1)
        order, cls, place, edge, h = by_class(before.reshape(-1, STATE), unit)
        # a trainer makes about 1,000 steps of Adagrad, so no weight passes 4 and no logit 70: exp cannot overflow
        wc, ww = net.logits()
        p = h @ wc
        less_told(p, cls)
        g = p.T @ h
        grad.wc[:], grad.bc[:] = g[:, :STATE].T, g[:, STATE]
        ds = p @ net.wc.T
        some = [(k, edge[k], edge[k + 1]) for k in range(CLASSES) if edge[k] < edge[k + 1]]
        for k, a, b in some:
            np.matmul(h[a:b], ww[k], out=p[a:b])
        less_told(p, place)
        g, part = np.zeros_like(ww), np.empty_like(ds)
        for k, a, b in some:
            np.matmul(h[a:b].T, p[a:b], out=g[k])
            np.matmul(p[a:b], net.ww[k].T, out=part[a:b])
        grad.ww[:], grad.bw[:] = g[:, :STATE], g[:, STATE]
        ds += part
        dh = np.empty_like(ds)
        dh[order] = ds
        dh = dh.reshape(n, lanes, STATE)
        back = np.zeros((lanes, STATE), np.float32)
        dx, dg = np.empty((n, lanes, 3 * STATE), np.float32), np.empty((n, lanes, 3 * STATE), np.float32)
        to_c = (1 - z) * (1 - c * c)
        to_z, to_r, turned = (before - c) * z * (1 - z), gc * r * (1 - r), np.ascontiguousarray(net.u.T)
        for t in range(n - 1, -1, -1):
            dc = back * to_c[t]
            np.multiply(back, to_z[t], out=dx[t, :, :STATE])
            np.multiply(dc, to_r[t], out=dx[t, :, STATE : 2 * STATE])
            dx[t, :, 2 * STATE :] = dc
            dg[t] = dx[t]
            dg[t, :, 2 * STATE :] *= r[t]
            back *= z[t]
            back += dg[t] @ turned
            back += dh[t]
            back *= keep[t]
        flat = dx.reshape(-1, 3 * STATE)
        grad.b[:] = np.ones(len(flat), np.float32) @ flat
        grad.u[:] = before.reshape(-1, STATE).T @ dg.reshape(-1, 3 * STATE)
        by = np.argsort(unit.astype(np.uint16), kind="stable")
        unit = unit[by]
        start = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        # two columns as one complex number: the same sums, and numpy makes them in half the steps
        gx = np.add.reduceat(flat.take(by, 0).view(np.complex64), start).view(np.float32)
        return grad, unit[start], gx, state

    def window_step(self, units: np.ndarray, goes_on: np.ndarray, state: np.ndarray) -> np.ndarray:
        grad, rows, gx, state = self.gradient(units, goes_on, state)
        scale = np.float32(16 / units.size)
        net = self.net
        x = net.x.size  # the embedding comes first; only rows that occur move
        seen = self.seen[:x].reshape(net.x.shape)
        g = np.clip(gx * scale, -1, 1)
        seen[rows] += g * g
        net.x[rows] -= self.rate * g / np.sqrt(seen[rows])
        g = grad.flat[x:]
        g *= scale
        np.clip(g, -1, 1, out=g)
        self.seen[x:] += g * g
        g *= self.rate
        g /= np.sqrt(self.seen[x:])
        net.flat[x:] -= g
        return state


def train(net: Network, texts: list[np.ndarray], lanes: int = 64, window: int = 16, rate: float = 0.05) -> None:
    """One pass over the units of texts."""
    own = Trainer(net, lanes, window, rate)
    for t in texts:
        own.add(t, (np.arange(len(t)) == 0).astype(np.int32))
    own.finish()


@np.errstate(over="ignore")
def score_units(net: Network, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's units, the state carried from end to end."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, length = first[:-1][order], size[order]
    total = np.zeros(len(size))
    h = np.zeros((len(size), STATE), np.float32)
    active = len(size)
    states, ids, owner, held = [], [], [], 0

    def flush() -> None:
        nonlocal held
        if held:
            total[:] += np.bincount(np.concatenate(owner), net.log_probability(np.concatenate(states), np.concatenate(ids)), len(size))
            states.clear(), ids.clear(), owner.clear()
            held = 0

    who = np.arange(len(size))
    x = net.x + net.b
    for t in range(int(length[0]) if len(size) else 0):
        active = int(np.searchsorted(-length, -t, "left")) if length[active - 1] <= t else active
        h = h[:active]
        unit = units[start[:active] + t]
        states.append(h)
        ids.append(unit)
        owner.append(who[:active])
        held += active
        if held >= 1 << 15:
            flush()
        h = net.gates(h, x.take(unit, 0))[0]
    flush()
    out = np.empty(len(size))
    out[order] = total
    return out


def _weights(learn: DataFrame, vocs, first: np.ndarray, total: int) -> np.ndarray:
    """Weights learned from all rows (doc_id, text)."""
    trainers = -(-total // TRAIN_TASK)
    lanes = int(min(LANES, max(8, total // 16384)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocs.value
        now, own = None, None

        def told() -> pa.RecordBatch:
            own.finish()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([own.net.flat.tobytes()], pa.binary()), pa.array([own.tokens], pa.int64())], ["trainer", "weights", "tokens"])

        for batch in batches:
            trainer, texts = batch.column(0).to_numpy(), W.column(batch, "text")
            cut = [0, *(np.flatnonzero(trainer[1:] != trainer[:-1]) + 1).tolist(), len(trainer)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo < hi and trainer[lo] != now:
                    if own:
                        yield told()
                    now, own = int(trainer[lo]), Trainer(Network(first.copy()), lanes)
                for a, b in W.slices(texts.slice(lo, hi - lo)):
                    h, rare, at = _tokens(texts.slice(lo + a, b - a))
                    one, back = W.index(h)
                    fresh = np.zeros(len(h), np.int32)
                    fresh[at[:-1]] = 1
                    own.add(voc.look(h[one], rare[one])[0][back], fresh)
        if own:
            yield told()

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("trainer")
        n = t["tokens"].to_numpy()
        out = sum(np.frombuffer(w.as_py(), np.float32) * np.float64(k) for w, k in zip(t["weights"], n, strict=True)) / n.sum()
        return pa.table({"trainer": pa.array([t["trainer"][0].as_py() // FAN], pa.int64()), "weights": pa.array([out.astype(np.float32).tobytes()], pa.binary()), "tokens": pa.array([int(n.sum())], pa.int64())})

    dealt = learn.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(trainers)).cast("int").alias("trainer"), F.xxhash64("text", "doc_id").alias("order"), "text")
    dealt = dealt.repartitionById(trainers, F.col("trainer")).sortWithinPartitions("trainer", "order")
    shape = "trainer long, weights binary, tokens long"
    made = stash(dealt.select("trainer", "text").mapInArrow(trimmed(fit), shape))
    while trainers > 1:
        made = stash(made.groupBy(F.floor(F.col("trainer") / FAN)).applyInArrow(mean, shape))
        trainers = -(-trainers // FAN)
    return np.frombuffer(made.first().weights, np.float32).copy()


def score(docs: DataFrame, folds: int = 5, held: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    learn = rows.filter("not held_out").select("text")
    counts = stash(word_counts(learn))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    voc = vocabulary(counts)
    net = Network.fresh(voc.start)
    vocs = spark.sparkContext.broadcast(voc)

    if total:
        net = Network(_weights(rows.filter("not held_out").select("doc_id", "text"), vocs, net.flat, int(total)))
    nets = spark.sparkContext.broadcast(net.flat)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "known", "model", "tail"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, net = vocs.value, Network(nets.value)
        half = np.log10(voc.mass)

        def emit(kept: list[tuple]) -> pa.RecordBatch:
            keys = pa.Table.from_batches([k[0] for k in kept]).combine_chunks().to_batches()[0]
            units, first = np.concatenate([k[1] for k in kept]), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.diff(k[2]) for k in kept]))])
            model = score_units(net, units, first) / np.log(10)
            tail, n = np.concatenate([k[3] for k in kept]), np.concatenate([k[4] for k in kept])
            cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate([k[5] for k in kept])))).astype(np.int32)
            known, base, rest = (np.concatenate([k[i] for k in kept]) for i in (6, 7, 8))
            items = pa.StructArray.from_arrays([pa.array(tail.view(np.int64)), pa.array(n)], ["word", "n"])
            return pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), keys.column(2), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(model + rest), pa.ListArray.from_arrays(cut, items)], names)

        kept: list[tuple] = []
        size = 0
        for batch in batches:
            texts = W.column(batch, "text")
            for a, b in W.slices(texts):
                h, rare, first = _tokens(texts.slice(a, b - a))
                one, back = W.index(h)
                u, c = voc.look(h[one], rare[one])
                units, count = u[back], c[back]
                doc = np.repeat(np.arange(b - a), np.diff(first))
                logs = np.log10(np.maximum(c, 0) + 0.5)[back]
                base = np.bincount(doc, np.where(count >= 0, logs, 0), b - a)
                known = np.bincount(doc, count > 0, b - a).astype(np.int64)
                odd = units >= UNITS - RARE
                rest = np.bincount(doc, np.where(odd, np.where(count >= 0, logs, 0) - half[np.maximum(units - (UNITS - RARE), 0)], 0), b - a)
                at = np.flatnonzero(count < 0)
                # the tail's words once per text
                order = at[np.lexsort((h[at], doc[at]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                where = np.flatnonzero(new)
                n = np.diff(np.append(where, len(order)))
                kept.append((batch.select(["row", "doc_id", "held_out"]).slice(a, b - a), units, first, h[order][where], n, np.bincount(doc[order][where], minlength=b - a), known, base, rest))
                size += len(units)
                if size >= CHUNK:
                    yield emit(kept)
                    kept, size = [], 0
        if kept:
            yield emit(kept)

    scored = stash(rows.mapInArrow(trimmed(look), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, model double, tail array<struct<word:long,n:long>>"))
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    joined = tail.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    every = float(np.log10(total + 0.5 * (distinct + 1)))
    rest = F.coalesce(F.col("sum"), F.lit(0.0))
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("known") + rest - F.col("n_tokens") * every).alias("base_score"), (F.col("model") + rest).alias("score"),
    )
