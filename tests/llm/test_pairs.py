"""Near duplicates and top-k against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from tessella.llm import words as W
from tessella.llm.common import components
from tessella.llm.minhash import near_duplicates, super_minhash
from tessella.llm.topk import top_k

from .fixtures import frame, rows


def split(t):
    return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def shingles(t, n):
    w = split(t)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(data, n, percent):
    sets = [shingles(r[1], n) for r in data]
    p = list(range(len(data)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                p[find(a)] = find(b)
    least = {}
    for k, r in enumerate(data):
        least[find(k)] = min(r[0], least.get(find(k), r[0]))
    return sorted((r[0], len(sets[k]), least[find(k)], r[0] == least[find(k)]) for k, r in enumerate(data))


def test_near_duplicates(spark):
    for n, percent in ((4, 80), (5, 60)):
        got = sorted(tuple(r) for r in near_duplicates(frame(spark), n, percent).collect())
        assert got == brute(rows(), n, percent)


def test_large_group_is_compared_by_blocks(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, texts, n=4), 4, 80).collect())
    assert got == brute(rows(texts, n=4), 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark).limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for j in (0.2, 0.5, 0.8):
        for _ in range(40):
            both = int(400 * j)
            h = rng.integers(0, 1 << 63, 800 - both, dtype=np.uint64)
            doc = np.concatenate((np.zeros(400, int), np.ones(400, int)))
            a = np.concatenate((h[:400], h[400 - both :][:400]))
            sig = super_minhash(a, doc, 2, 96)
            errors.append((sig[0] == sig[1]).mean() - both / (800 - both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_short_sets_fill_their_signature():
    sig = super_minhash(np.array([5, 6], np.uint64), np.array([0, 2]), 3, 96)
    assert (sig[[0, 2]] != 0xFFFFFFFF).all() and (sig[1] == 0xFFFFFFFF).all()


def test_words_and_hashes():
    texts = ["a B\tc", "", "b", "x\n", "été B", "b"]
    w = W.split(pa.array(texts))
    assert [w.word(k).decode() for k in range(len(w.start))] == [x for t in texts for x in split(t)]
    assert np.diff(w.first).tolist() == [len(split(t)) for t in texts]
    h = w.hashes()
    by = {}
    for k in range(len(h)):
        by.setdefault(w.word(k), set()).add(int(h[k]))
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark):
    rng = random.Random(4)
    data = [(k, [rng.uniform(-0.5, 0.5) for _ in range(12)]) for k in range(400)]
    data += [(400, None), (450, [None, 1.0]), (500, [math.nan] * 12), (550, [math.inf] * 12), (600, list(data[3][1])), (601, list(data[3][1])), (650, [0.0] * 12), (700, [0.25])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, label int")
    good = {}
    for i, v in data:
        if v and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            good[i] = q + [0] * (12 - len(q))
    want = []
    for i, q in good.items():
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, good[j], strict=True)), j) for j in good if j != i)[:5]
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    assert sorted(tuple(r) for r in top_k(df).collect()) == sorted(want)
    assert top_k(df.limit(0)).count() == 0
    assert top_k(df.filter("vec_id = 50")).count() == 0
