import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import periodic as P
from tessella.llm import queries as Q

from .fixtures import frame, rows


def brute(ids, least=24, times=3):
    """Every maximal stretch of every period, by comparing words; a stretch whose period is not its smallest goes."""
    n, out = len(ids), []
    for p in range(1, n // times + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and ids[e] == ids[e + p]:
                e += 1
            a, b = s, e + p
            if e > s and b - a >= max(least, times * p) and not any(all(ids[k] == ids[k + q] for k in range(a, b - q)) for q in range(1, p)):
                out.append((a, b - a, p))
            s = e + 1
    return sorted(out)


def told(i, text, plant=False):
    w = (text or "").encode().split()
    n = len(w)
    if plant and i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    number = {x: k for k, x in enumerate(set(w))}
    runs = brute([number[x] for x in w])
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(kept))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 2, 3])
        ids = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.7 and n > 6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            ids[a:] = [ids[a + (k - a) % p] for k in range(a, n)]
            if rng.random() < 0.5:
                ids[rng.randrange(n)] = rng.randrange(kinds)
        least, times = rng.choice([(24, 3), (6, 3), (4, 2), (1, 2), (9, 4)])
        assert [tuple(r) for r in P.find_runs(np.array(ids, np.int64), least, times).tolist()] == brute(ids, least, times)


def test_runs_survive_hashes_that_lie(monkeypatch):
    """With hashes that call everything equal, words decide."""
    monkeypatch.setattr(P.Prefixes, "same", lambda self, at, apart, length: np.ones(len(at), bool))
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(2) for _ in range(60)]
        ids[20:50] = [ids[20 + k % 5] for k in range(30)]
        assert [tuple(r) for r in P.find_runs(np.array(ids, np.int64), 12, 3).tolist()] == brute(ids, 12, 3)


def test_slabs_and_long_texts(monkeypatch):
    ids = np.array([1, 2, 3] * 500 + list(range(9, 500)) + [7] * 900, np.int64)
    want = P.find_runs(ids).tolist()
    assert want == [[0, 1500, 3], [1991, 900, 1]]
    monkeypatch.setattr(P, "SLAB", 50)
    assert P.find_runs(ids).tolist() == want
    assert P.find_runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    with pytest.raises(ValueError):
        P.find_runs(ids, 24, 1)


def awkward(spark):
    more = ["a b c " * 30, "x " + "y z " * 11 + "y", "x " + "y z " * 12, "q " * 24 + "r " * 24 + "r s t " * 9, "nul\x00nul " * 30, "no break " * 40]
    return frame(spark, more), rows(more)


def test_operator_on_awkward_rows(spark):
    df, plain = awkward(spark)
    clash = df.withColumn("key", F.lit("k")).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    got = sorted((r.key, r.n_words, len(r.runs), hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in P.periodic_runs(clash).collect())
    assert got == sorted((i, len((t or "").encode().split()), told(i, t)[1], told(i, t)[-1]) for i, t, *_ in plain)
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    df, plain = awkward(spark)
    folder = str(tmp_path)
    df.unionByName(spark.createDataFrame([(None, "a b " * 40, "", "", 1, "", 1, 2, 3)], df.schema)).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, Q.op13_periodic_runs(spark, folder).collect()), key=str)
    assert got == sorted([told(i, t, True) for i, t, *_ in plain] + [told(None, "a b " * 40)], key=str)
    assert sum(r[1] > 0 for r in got) >= 9
