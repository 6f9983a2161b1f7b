"""Language identification by a linear-chain conditional random field over words.

Each word has features (the word itself, its beginnings and endings of one to three bytes,
its byte bigrams and trigrams, and the languages that a lexicon of the training texts gives it),
hashed into one table of weights by language; learned transitions join neighbours, and learned
start potentials begin a text.  Forward-backward gives each word's language; a text's language
is the one with the most expected words, ties to the first by name.  All texts of a batch go in
step, so no text is cut.

Training (documented bound): the whole texts of ``SAMPLE`` labelled rows, chosen by a hash of
text and label; texts are strung together, so switches are seen too.  The lexicon counts all
words of all training rows by language, hashed into ``LEXICON`` cells: integer sums, the same
in any partitioning.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
training rows every text is ``und``; a text with several labels trains with each; repeated rows
get a row each; an empty table gives none; further columns, whatever their names, are ignored
(``keep_identified`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import words as W
from .common import bounded_sample, prepare, release, trimmed

U = np.uint64
SAMPLE, LEXICON, TABLE = 1000, 1 << 17, 1 << 16
#: Words that a task labels in step, and words whose features it keeps.
CHUNK, KEPT = 400_000, 1 << 16


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (TABLE, languages)
    moves: np.ndarray  # log potentials (from, to)
    first: np.ndarray
    tongue: np.ndarray  # (LEXICON, languages) share of each language in a cell's words


def _cell(h: np.ndarray) -> np.ndarray:
    """A word's cell in the lexicon."""
    return (W.mix(h) >> U(8)).astype(np.int64) % LEXICON


def _features(words: W.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the features of the words ``at``, and the number of each word's features."""
    data = words.data.astype(U)
    start, end = words.start[at], words.end[at]
    size = end - start
    parts, own = [], []
    who = np.arange(len(at))
    for k in (1, 2, 3):
        ok = size >= k
        for kind, s in ((k, start[ok]), (8 + k, end[ok] - k)):
            h = np.full(int(ok.sum()), kind, U)
            for j in range(k):
                h = h * U(W.BASE) + data[s + j]
            parts.append(h)
            own.append(who[ok])
    places = np.repeat(start - np.concatenate((np.zeros(1, np.int64), np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    left = np.repeat(end, size) - places
    byte_of = np.repeat(who, size)
    for k in (2, 3):
        ok = left >= k
        h = np.full(int(ok.sum()), 16 + k, U)
        for j in range(k):
            h = h * U(W.BASE) + data[places[ok] + j]
        parts.append(h)
        own.append(byte_of[ok])
    parts.append(words.hashes()[at])
    own.append(who)
    h, o = W.mix(np.concatenate(parts)) % U(TABLE), np.concatenate(own)
    order = np.argsort(o, kind="stable")
    return h[order].astype(np.int64), np.bincount(o, minlength=len(at))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` of them at a time (each at least one)."""
    return np.add.reduceat(values, np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)[:-1])), 0) if len(counts) else values[:0]


def emissions(model: Model, words: W.Words, at: np.ndarray) -> np.ndarray:
    """Log potentials (words, languages) of the words ``at``."""
    rows, counts = _features(words, at)
    out = _sums(model.weights[rows], counts)
    return out + model.tongue[_cell(words.hashes()[at])]


class _Emitter:
    """Emissions of all words; those of words seen before are kept in a table by hash."""

    def __init__(self, model: Model):
        self.model = model
        self.key, self.value = np.zeros(KEPT, U), np.zeros((KEPT, len(model.langs)), np.float32)

    def __call__(self, words: W.Words) -> np.ndarray:
        h = words.hashes()
        one, back = W.index(h)
        h = h[one]
        at = (h & U(KEPT - 1)).astype(np.int64)
        out = self.value[at]
        new = np.flatnonzero(self.key[at] != h)
        out[new] = emissions(self.model, words, one[new])
        self.key[at[new]], self.value[at[new]] = h[new], out[new]
        return out[back]


def marginals(model: Model, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward: each word's probabilities, texts in step (longest first)."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True)) if n else scores
    move, begin = np.exp(model.moves).astype(np.float32), np.exp(model.first).astype(np.float32)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, length = first[:-1][order], size[order]
    out = np.empty((n, k), np.float32)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    a = np.tile(begin, (len(size), 1))
    for t, active in enumerate(live.tolist()):
        at = start[:active] + t
        a = (a[:active] @ move if t else a[:active]) * e[at]
        a /= a.sum(1, keepdims=True)
        out[at] = a
    b = np.ones((len(size), k), np.float32)
    for t in range(len(live) - 1, -1, -1):
        active = int(live[t])
        at = start[:active] + t
        p = out[at] * b[:active]
        out[at] = p / p.sum(1, keepdims=True)
        if t:
            nb = (b[:active] * e[at]) @ move.T
            b[:active] = nb / nb.sum(1, keepdims=True)
    return out


def fit(texts: list[str], labels: list[int], langs: list[str], tongue: np.ndarray, passes: int = 3, lanes: int = 32, window: int = 24, rate: float = 0.3) -> Model:
    """Maximum likelihood of the labels (Adagrad over windows of ``lanes`` word sequences, each a
    chain from its start potentials on)."""
    k = len(langs)
    model = Model(langs, np.zeros((TABLE, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32), tongue)
    words = W.split(pa.array(texts, pa.string()))
    n = len(words.start)
    if n < 2 or k < 2:
        return model
    gold = np.array(labels)[words.doc]
    uniq, one, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    made = [_features(words, one[k : k + 8192]) for k in range(0, len(one), 8192)]
    rows, counts = np.concatenate([r.astype(np.int32) for r, _ in made]), np.concatenate([c for _, c in made])
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    lanes = max(1, min(lanes, n // window))
    steps = n // lanes
    flow, want = back[: lanes * steps].reshape(lanes, steps), gold[: lanes * steps].reshape(lanes, steps)
    gw, gm, gf = np.full(model.weights.shape, 1e-2, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
    extra = tongue[_cell(uniq)]
    for turn in range(passes):
        for t0 in np.random.default_rng(turn).permutation(np.arange(0, steps, window)):
            ids, y = flow[:, t0 : t0 + window].reshape(-1), want[:, t0 : t0 + window]
            kinds, own = np.unique(ids, return_inverse=True)
            take = np.concatenate([np.arange(edge[u], edge[u + 1]) for u in kinds])
            base = _sums(model.weights[rows[take]], counts[kinds]) + extra[kinds]
            e = base[own].reshape(*y.shape, k)
            e = np.exp(e - e.max(2, keepdims=True))
            move = np.exp(model.moves)
            m = y.shape[1]
            alpha, beta = np.empty(e.shape), np.empty(e.shape)
            a = np.exp(model.first) * e[:, 0]
            alpha[:, 0] = a / a.sum(1, keepdims=True)
            for t in range(1, m):
                a = (alpha[:, t - 1] @ move) * e[:, t]
                alpha[:, t] = a / a.sum(1, keepdims=True)
            beta[:, m - 1] = 1
            expect = np.zeros((k, k))
            for t in range(m - 1, 0, -1):
                b = beta[:, t] * e[:, t]
                joint = alpha[:, t - 1][:, :, None] * move[None] * b[:, None, :]
                expect += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = b @ move.T
                beta[:, t - 1] = b / b.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            g = (p[:, 0].sum(0) - np.bincount(y[:, 0], minlength=k)) / 16
            gf += g * g
            model.first[:] -= rate * g / np.sqrt(gf)
            p = p.reshape(-1, k)
            p[np.arange(len(p)), y.reshape(-1)] -= 1
            by_word = np.stack([np.bincount(own, p[:, c], len(kinds)) for c in range(k)], 1) / 16
            spread = np.repeat(by_word, counts[kinds], 0)
            cells, back_ = np.unique(rows[take], return_inverse=True)
            g = np.stack([np.bincount(back_, spread[:, c], len(cells)) for c in range(k)], 1) + 1e-4 * model.weights[cells]
            gw[cells] += g * g
            model.weights[cells] -= rate * g / np.sqrt(gw[cells])
            np.subtract.at(expect, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
            expect /= 16
            gm += expect * expect
            model.moves[:] -= rate * expect / np.sqrt(gm)
    model.moves[:] -= model.moves.max()
    model.first[:] -= model.first.max()
    return model


def _word_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(cell, lang, n): words of the whole texts of rows (text, lang) by cell of the lexicon."""
    place = {x: k for k, x in enumerate(langs)}

    def merged(held: list[tuple]) -> tuple:
        uniq, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return uniq, np.bincount(back, np.concatenate([x[1] for x in held]), len(uniq)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = [(np.zeros(0, np.int64),) * 2]
        size = 0
        for batch in batches:
            texts, lang = W.column(batch, "text"), np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in W.slices(texts):
                words = W.split(texts.slice(a, b - a))
                held.append(np.unique(_cell(words.hashes()) * len(langs) + lang[a:b][words.doc], return_counts=True))
                size += len(held[-1][0])
                if size >= 2 * CHUNK:  # cells and languages are few: what stays is bounded
                    held = [merged(held)]
                    size = len(held[0][0]) // 2
        uniq, n = merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(uniq // len(langs)), pa.array(uniq % len(langs)), pa.array(n)], ["cell", "lang", "n"])

    return rows.mapInArrow(trimmed(run), "cell long, lang long, n long").groupBy("cell", "lang").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> Model:
    """A model of the rows (text, lang), neither null."""
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # the languages
    if not langs:
        return Model([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), np.zeros((LEXICON, 0), np.float32))
    told = _word_counts(rows, langs).toArrow()  # LEXICON cells by language
    n = np.full((LEXICON, len(langs)), 0.5)
    n[told["cell"].to_numpy(), told["lang"].to_numpy()] += told["n"].to_numpy()
    tongue = (np.log(n / n.sum(1, keepdims=True)) * 0.25).astype(np.float32)
    named = rows.select(F.md5("text").alias("h"), "lang", "text")
    some = bounded_sample(named.select("h", "lang").distinct(), F.struct("h", "lang"), SAMPLE)
    chosen = named.join(F.broadcast(some), ["h", "lang"]).groupBy("h", "lang").agg(F.first("text").alias("text"))  # SAMPLE keys are broadcast
    texts = sorted((r.h, r.lang, r.text) for r in chosen.collect())  # SAMPLE rows
    model = fit([t for _, _, t in texts], [langs.index(x) for _, x, _ in texts], langs, tongue)
    release()
    return model


def identify(docs: DataFrame, folds: int = 4, held: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_words, n_switches, words_by_lang."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), _fold(key, folds, held).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
    )
    model = spark.sparkContext.broadcast(learn(rows.filter("not held_out and text is not null and lang is not null").select("text", "lang")))
    return label(rows, model)


def _fold(key: str, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == held, F.lit(False))


def _labelled(m: Model, batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(first ``width`` columns, language or -1, score, words, switches, words by language) of
    stretches of batches that end with text and lettered; the last four by text."""
    k = len(m.langs)
    emit = _Emitter(m)

    def told(kept: list[tuple]) -> tuple:
        scores, counted = np.concatenate([x[1] for x in kept]), np.concatenate([x[2] for x in kept])
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate([np.diff(x[3]) for x in kept]))))
        lettered = pa.concat_arrays([x[4] for x in kept]).to_numpy(zero_copy_only=False).astype(bool)
        n = len(first) - 1
        p = marginals(m, scores, first) if k else np.zeros((len(scores), 0), np.float32)
        doc = np.repeat(np.arange(n), np.diff(first))
        # words without a letter follow their neighbours and count for nothing, unless there are no others
        weight = np.where(counted, 1.0, 1e-6)
        total = np.stack([np.bincount(doc, p[:, c] * weight, n) for c in range(k)], 1) if k else np.zeros((n, 0))
        sure = lettered & (k > 0) & (total.sum(1) > 0)
        best = total.argmax(1) if k else np.zeros(n, int)
        share = np.where(sure, (total[np.arange(n), best] if k else 0) / np.maximum(total.sum(1), 1e-12), 0.0)
        mode = p.argmax(1) if k and len(p) else np.zeros(len(doc), int)
        dc, mc = doc[counted], mode[counted]
        switch = np.bincount(dc[1:][(dc[1:] == dc[:-1]) & (mc[1:] != mc[:-1])], minlength=n)
        by = np.bincount(dc * max(k, 1) + mc, minlength=n * max(k, 1)).reshape(n, -1)[:, :k]
        keys = pa.Table.from_batches([x[0] for x in kept]).combine_chunks()
        return keys, np.where(sure, best, -1), np.round(np.clip(share, 0, 1).astype(float), 6), np.bincount(dc, minlength=n), switch, by

    kept: list[tuple] = []
    size = 0
    for batch in batches:
        texts, lettered = W.column(batch, "text"), batch.column(batch.num_columns - 1)
        for a, b in W.slices(texts):
            words = W.split(texts.slice(a, b - a))
            is_letter = np.concatenate((np.zeros(1, np.int64), np.cumsum(((words.data >= 97) & (words.data <= 122)) | (words.data >= 0x80))))
            counted = is_letter[words.end] > is_letter[words.start]
            kept.append((batch.select(list(range(width))).slice(a, b - a), emit(words), counted, words.first, lettered.slice(a, b - a)))
            size += len(counted)
            if size >= CHUNK:
                yield told(kept)
                kept, size = [], 0
    if kept:
        yield told(kept)


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")


def label(rows: DataFrame, model) -> DataFrame:
    """Rows (doc_id, held_out, text) under a broadcast model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model.value.langs
        for keys, best, score, n_words, switches, by in _labelled(model.value, batches, 2):
            on = by > 0
            maps = pa.MapArray.from_arrays(np.concatenate((np.zeros(1, np.int64), np.cumsum(on.sum(1)))).astype(np.int32), pa.array([langs[c] for c in np.nonzero(on)[1]], pa.string()), pa.array(by[on], pa.int64()))
            pred = [langs[b] if b >= 0 else "und" for b in best.tolist()]
            cols = [keys.column(0).combine_chunks(), keys.column(1).combine_chunks(), pa.array(pred, pa.string()), pa.array(score), pa.array(n_words), pa.array(switches), maps]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", "words_by_lang"])

    return rows.select("doc_id", "held_out", "text", _lettered()).mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long, words_by_lang map<string,long>")


def keep_identified(docs: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language cannot be told: ``und``, or no language with a
    share of ``least`` of the words.  Rows pass through the scan as they are: no join, no
    shuffle, and no name that could clash."""
    prepare(docs.sparkSession)
    body = F.col(f"`{text}`").cast("string")
    known = docs.filter(~_fold(key, 4, 2)).select(body.alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    model = docs.sparkSession.sparkContext.broadcast(learn(known))
    width = len(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], body.alias("text"))
    shape = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, best, score, *_ in _labelled(model.value, batches, width):
            yield from keys.filter(pa.array((best >= 0) & (score >= least))).to_batches()

    return rows.select("*", _lettered()).mapInArrow(trimmed(run), shape).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
