"""Toxicity, language ID, segmentation and language-model scores."""

import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import crf, gru, toxicity
from tessella.llm.pieces import lattice, segmentations
from tessella.llm.tokens import tokenizer_path

from .fixtures import SCHEMA, frame, rows


def crc(i):
    return zlib.crc32(str(i).encode())


def split(t):
    return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def test_base_scores_and_probabilities(spark):
    counts = Counter()
    data = rows()
    for r in data:
        if crc(r[0]) % 5 != 1:
            counts.update([*split(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    got = {(r.doc_id): r for r in gru.score(frame(spark)).collect()}
    assert len(got) == len({r[0] for r in data})
    for r in data:
        t = [*split(r[1]), None]
        x = got[r[0]]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (crc(r[0]) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert x.score < 0
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) * 1.2
    assert gru.score(frame(spark).limit(0)).count() == 0


def test_tail_counts_come_by_join(spark, monkeypatch):
    whole = {r.doc_id: r for r in gru.score(frame(spark)).collect()}
    monkeypatch.setattr(gru, "HEAD", 50)
    for r in gru.score(frame(spark)).collect():
        assert r.n_known == whole[r.doc_id].n_known and r.base_score == pytest.approx(whole[r.doc_id].base_score)


def test_network_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    net = gru.Network.fresh(np.ones(gru.UNITS))
    h = rng.normal(size=(1, gru.STATE)).astype(np.float32)
    every = np.arange(gru.UNITS)
    p = np.exp(net.log_probability(np.repeat(h, gru.UNITS, 0), every))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    texts = [np.tile([5, 9, 700, 3], 12).astype(np.int32) for _ in range(200)]
    first = np.array([0, 48])
    before = gru.score_units(net, texts[0], first)[0]
    gru.train(net, texts, lanes=8)
    assert gru.score_units(net, texts[0], first)[0] > before / 4
    # the state goes on: two texts in step score as each alone
    flat = np.concatenate((texts[0], texts[0][:7]))
    both = gru.score_units(net, flat, np.array([0, 48, 55]))
    assert both == pytest.approx([gru.score_units(net, texts[0], first)[0], gru.score_units(net, texts[0][:7], np.array([0, 7]))[0]], rel=1e-5)


def test_gradients():
    """Of every part of the network against differences of the loss, a text that begins anew included."""
    rng = np.random.default_rng(2)
    net = gru.Network.fresh(np.ones(gru.UNITS))
    text = rng.integers(0, gru.UNITS, 8).astype(np.int32)
    goes_on = np.array([0, 1, 1, 1, 1, 0, 1, 1])[:, None]
    grad, rows_of_x, gx, _ = gru.Trainer(net, 1).gradient(text[:, None], goes_on == 1, np.zeros((1, gru.STATE), np.float32))
    grad.x[rows_of_x] = gx
    start = net.flat.copy()
    size = np.abs(grad.flat)
    at = np.argsort(-size)[[0, 50, 200, 400, 800]].tolist() + [int(np.argmax(np.abs(getattr(grad, n)))) + getattr(net, n).__array_interface__["data"][0] // 4 - net.flat.__array_interface__["data"][0] // 4 for n in net.SHAPES]
    for k in at:
        e = 1e-2
        up, down = start.copy(), start.copy()
        up[k] += e
        down[k] -= e
        slope = -(gru.score_units(gru.Network(up), text, np.array([0, 5, 8])).sum() - gru.score_units(gru.Network(down), text, np.array([0, 5, 8])).sum()) / (2 * e)
        assert slope == pytest.approx(grad.flat[k], rel=0.05, abs=5e-3)


def test_kernels_against_plain_formulas():
    rng = np.random.default_rng(5)
    net = gru.Network.fresh(rng.integers(0, 50, gru.UNITS).astype(float))
    net.b[:] = rng.normal(size=net.b.shape)
    h, x = rng.normal(size=(40, gru.STATE)).astype(np.float32), rng.normal(0, 3, (40, 3 * gru.STATE)).astype(np.float32)
    x[0], x[1] = 300, -300  # beyond what exp can hold
    with np.errstate(over="ignore"):
        new, z, r, gc, c = net.gates(h, x)
    s, g = gru.STATE, (h @ net.u).astype(float)
    want_z, want_r = (0.5 + 0.5 * np.tanh(0.5 * (x[:, a : a + s] + g[:, a : a + s])) for a in (0, s))
    want_c = np.tanh(x[:, 2 * s :] + want_r * g[:, 2 * s :])
    for got, want in ((z, want_z), (r, want_r), (gc, g[:, 2 * s :]), (c, want_c), (new, want_c + want_z * (h - want_c))):
        assert np.allclose(got, want, atol=2e-6) and got.dtype == np.float32
    unit = rng.integers(0, gru.UNITS, 40)
    order, cls, place, edge, wide = gru.by_class(h, unit)
    assert (cls == unit[order] % gru.CLASSES).all() and (place == unit[order] // gru.CLASSES).all() and edge[-1] == 40
    assert all((cls[a:b] == k).all() for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)))
    logits = wide @ net.logits()[0]
    want = np.exp(h[order] @ net.wc + net.bc)
    want /= want.sum(1, keepdims=True)
    want[np.arange(40), cls] -= 1
    gru.less_told(logits, cls)
    assert np.allclose(logits, want, atol=1e-6)


def test_every_token_trains(spark, monkeypatch):
    """Several trainers read all tokens of the fold, the same in any layout, and hold a buffer only."""
    read = []
    monkeypatch.setattr(gru, "TRAIN_TASK", 1500)
    monkeypatch.setattr(gru, "FAN", 2)
    monkeypatch.setattr(gru, "stash", lambda df, real=gru.stash: (lambda out: (read.append(out), out)[1])(real(df)))
    scores = []
    for parts in (1, 7):
        read.clear()
        scores.append({r.doc_id: (r.score, r.train_tokens) for r in gru.score(frame(spark).repartition(parts)).collect()})
        made = [x.collect() for x in read if x.columns == ["trainer", "weights", "tokens"]]
        assert len(made) > 2 and all(sum(r.tokens for r in x) == next(iter(scores[-1].values()))[1] for x in made) and len(made[-1]) == 1
    assert all(scores[0][k][0] == pytest.approx(scores[1][k][0], rel=1e-5) for k in scores[0])


def test_buffers_carry_on():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (70, 3, 200, 1, 90, 40)]
    sizes = []
    for parts in (texts, [np.concatenate(texts)]):
        own = gru.Trainer(gru.Network.fresh(np.ones(gru.UNITS)), 4)
        own._learn = lambda flow: sizes.append(flow.shape[1])
        old, gru.BUFFER = gru.BUFFER, 64
        try:
            for t in parts:
                own.add(t, (np.arange(len(t)) == 0).astype(np.int32))
                assert own.held < 64
            own.finish()
        finally:
            gru.BUFFER = old
        assert own.tokens == 404
    assert sizes == [64] * 6 + [20] + [64] * 6 + [20]


def labelled():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastything"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    docs += [(1000, "some v1leword and n@stything and v.i.l.e.w.o.r.d here"), (1001, None), (1002, ""), (1003, "a b c " * 3000)]
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled()
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(*docs[0], "x")] * 2, "doc_id long, text string, y string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.score(df, lab).collect()
    assert len(got) == len(docs) + 2
    by = {r.doc_id: r for r in got}
    truth = {i: y for i, y, _ in labels}
    assert all(by[i].held_out == (crc(i) % 3 == 1) and 0 <= by[i].score <= 1 and by[i].predicted == int(by[i].score >= 0.7) for i, _ in docs)
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].predicted == truth[i] for i in held) > 0.97 * len(held)
    assert by[1000].predicted == 1 and by[1001].predicted == 0 and by[1001].score == by[1002].score
    blank = toxicity.score(df, lab.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}
    assert toxicity.score(df.limit(0), lab).count() == 0


def test_restoring():
    n = np.zeros((28, 28, 28))
    for w in ["idiot", "moron", "scum", "trash", "the", "and"] * 50:
        c = [0, 0, *[ord(x) - 96 for x in w], 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            n[a, b, d] += 1
    m = toxicity.CharacterModel(n.reshape(-1))
    for seen, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("tr@sh", "trash"), ("s-c-u-m", "scum"), ("morrrron", "moron"), ("idi0t!!", "idiot")):
        assert m.restore(seen) == word


def test_restoring_is_the_least_path():
    """Against the enumeration of all paths of short lattices."""
    rng = random.Random(6)
    m = toxicity.CharacterModel(np.array([rng.randrange(20) for _ in range(28**3)], float))
    t = toxicity

    def paths(token):
        out = [((), 0.0)]
        for at, ch in enumerate(token):
            stand = t.LEET.get(ch, "")
            options = [(ch, 0.0)] * ("a" <= ch <= "z") + [(c, t.STAND if len(stand) < 3 else t.ANY) for c in stand]
            if at and ch == token[at - 1] and options:
                drop = t.REPEAT if token[max(0, at - 2) : at + 3].count(ch) > 2 else t.PAIR
            else:
                drop = t.SOME if stand else None if options else t.DROP
            out = [((*p, c), v + x) for p, v in out for c, x in options] + [(p, v + drop) for p, v in out if drop is not None]
        return out

    def cost(p, v):
        c = [0, 0, *[ord(x) - 96 for x in p], 0]
        return v + sum(m.cost[a, b, d] for a, b, d in zip(c, c[1:], c[2:], strict=False))

    for token in ("a1b", "5h17", "a$$", "b-o-b", "h@@a", "lll1x", "x3-4y", "zzz"):
        best = min((cost(p, v), "".join(p)) for p, v in paths(token))
        assert m.restore(token) == best[1], token


def test_what_is_decoded():
    for text, want in (("5h17 here", ["5h17"]), ("a$$ as$ $h!7", ["a$$", "as$", "$h!7"]), ("plain words! 2024 3.5 x", []), ("you are a s t u p i d", ["astupid", "stupid", "tupid", "upid"])):
        assert t_tokens(text) == want


def t_tokens(text):
    return toxicity.disguised(toxicity.W.split(pa.array([text])))[0]


def test_language_id(spark):
    rng = random.Random(8)
    tongues = {"aa": "kelomi", "bb": "zurtax", "cc": "épàñbn"}
    data = []
    for i in range(240):
        lang = rng.choice(list(tongues))
        t = " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(2, 40)))
        data.append((i, t, lang if i % 7 else None))
    odd = [(500, None, "aa"), (501, "", "aa"), (502, "123 456 !!", "bb"), (503, "kelo miko zurt taxu urtaz xarzu", None), (504, "kelo " * 9000, "aa"), (0, data[0][1], data[0][2])]
    df = spark.createDataFrame([(*d, 1) for d in data + odd], "doc_id long, text string, lang string, score int").repartition(3)
    got = crf.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data) + len(odd)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == lang for i, _, lang in data if lang)
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert set(by[503].words_by_lang) == {"aa", "bb"} and by[503].n_switches >= 1
    kept = {r.doc_id for r in crf.keep_identified(df).collect()}
    assert kept == set(by) - {500, 501, 502}
    assert crf.identify(df.limit(0)).count() == 0


def test_lexicon_counts_every_word(spark):
    """A word counts in any layout, also one that stands once in each slice, or once in a rare language."""
    data = [(f"common w{i % 7} only{i} rare", "aa" if i % 10 else "bb") for i in range(60)]
    want = Counter()
    for t, lang in data:
        want.update((w, lang == "bb") for w in t.split())
    for parts in (1, 60):
        got = crf._word_counts(spark.createDataFrame(data, "text string, lang string").repartition(parts), ["aa", "bb"]).collect()
        assert sorted(r.n for r in got) == sorted(want.values()) and len(got) == len({(r.cell, r.lang) for r in got})


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    m = crf.Model(["a", "b"], np.zeros((4, 2), np.float32), rng.normal(size=(2, 2)).astype(np.float32), rng.normal(size=2).astype(np.float32), np.zeros((crf.LEXICON, 2), np.float32))
    s = rng.normal(size=(7, 2)).astype(np.float32)
    got = crf.marginals(m, s, np.array([0, 4, 4, 7]))
    for a, b in ((0, 4), (4, 7)):
        total = np.zeros((b - a, 2))
        for path in np.ndindex(*(2,) * (b - a)):
            w = m.first[path[0]] + sum(s[a + k, y] for k, y in enumerate(path)) + sum(m.moves[x, y] for x, y in zip(path, path[1:], strict=False))
            for k, y in enumerate(path):
                total[k, y] += np.exp(w)
        assert got[a:b] == pytest.approx(total / total.sum(1, keepdims=True), abs=1e-4)


def every_segmentation(net, text):
    if not text:
        return [(0.0, [])]
    out = []
    first = len(text.decode()[0].encode())
    for n in range(1, len(text) + 1):
        i = net.known.get(text[:n], -1)
        if i >= 0 or n == first:
            ids, v = ([i], net.scores[i]) if i >= 0 else ([int(net.bytes[b]) for b in text[:n]], net.unknown)
            out += [(v + s, [*ids, *rest]) for s, rest in every_segmentation(net, text[n:])]
    return out


def test_n_best_segmentations(spark):
    texts = ["Hello you", "é☃x", " a", "ab\ncd", "x", "the cat", "  "]
    net = lattice(tokenizer_path("piece_bpe_32k.model"))
    for t in texts:
        want = sorted((-s for s, _ in every_segmentation(net, (" " + t).encode())))[:4]
        (ids, best, total, same), = net.encode(pa.array([t]), 4)
        assert [-s for s, _ in best] == pytest.approx(want) and same and total == pytest.approx(-want[0])
        assert net.decode(ids) == t.encode()
    for t in ("a ▁ b", "▁"):  # the mark of a space is read as a space
        (ids, _, _, same), = net.encode(pa.array([t]), 4)
        assert not same and net.decode(ids).decode() == t.replace("▁", " ")
    got = segmentations(frame(spark), with_ids=True).collect()
    text = {r[0]: r[1] or "" for r in rows()}
    assert len(got) == len(rows()) and all(r.round_trip for r in got)
    for r in got:
        assert net.decode(np.array(r.ids)).decode() == text[r.doc_id] and r.n_pieces == len(r.ids)
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.score
    assert segmentations(frame(spark).limit(0)).count() == 0


def n_best_scores(net, segment, n):
    """By the n best scores of every prefix, without an agenda."""
    best = [[0.0]] + [[] for _ in segment]
    for e in range(1, len(segment) + 1):
        for p in range(max(0, e - net.widest), e):
            i = net.known.get(segment[p:e], -1)
            if i >= 0 or (e == p + 1 and segment[p] < 128):
                best[e] += [s + (net.scores[i] if i >= 0 else net.unknown) for s in best[p]]
        best[e] = sorted(best[e], reverse=True)[:n]
    return best[-1]


@pytest.mark.parametrize("size", [40, 4000, 9000])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnop"])
def test_long_segments_have_the_same_n_best(size, letters):
    net = lattice(tokenizer_path("piece_bpe_32k.model"))
    token = "".join(random.Random(size).choices(letters, k=size))
    segment = (" " + token).encode()
    found = net.search(segment, 4)
    assert [s for s, _ in found] == pytest.approx(n_best_scores(net, segment, 4))
    assert len({tuple(ids) for _, ids in found}) == 4
    assert all(net.decode(np.array(ids)).decode() == token and sum(net.scores[i] for i in ids) == pytest.approx(s) for s, ids in found)
    (ids, best, total, same), = net.encode(pa.array([token]), 4)
    assert same and [s for s, _ in best] == pytest.approx([s for s, _ in found]) and total == pytest.approx(found[0][0])


def test_a_token_of_a_million_characters():
    """In a process of its own, whose memory is held under 1 GB."""
    code = """
import resource
import pyarrow as pa
from tessella.llm.pieces import Lattice
from tessella.llm.tokens import tokenizer_path
ids, best, total, same = next(Lattice(tokenizer_path("piece_bpe_32k.model")).encode(pa.array(["a" * 1_000_000]), 4))
assert same and len(best) == 4 and best[0][0] == total
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20
"""
    root = str(Path(__file__).resolve().parents[2])
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env={**os.environ, "PYTHONPATH": root}, timeout=400)


def test_empty_frames_keep_their_schema(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert gru.score(empty).columns[:2] == ["doc_id", "held_out"]
