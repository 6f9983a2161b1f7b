import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from tessella.llm import resampling as R

from .fixtures import frame, rows


def brute(docs, target, percent=25, least=20, buckets=10000, seed=7):
    def read(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return w, [zlib.crc32(x.encode()) % buckets for x in w + [a + " " + b for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    found = [(i, *read(x)) for i, x in docs]
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(read(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, w, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


TARGET = ["Abc def ghi jkl", "long long abcd", None, "", "12 déf 12 déf"]
MORE = ["Abc-def_ghi 12 déf " * 9, "abc\x00def " * 30, "long " * 25, "x"]


def test_against_brute_force(spark):
    df = frame(spark, MORE).withColumns({c: F.lit("c") for c in ("key", "digest", "copies", "weight", "score", "rank", "_above", "_most", "bucket")})
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, copies int")
    plain = [(i, t) for i, t, *_ in rows(MORE)]
    for percent, least in ((25, 20), (100, 1), (0, 20)):
        got = sorted((tuple(r) for r in R.resample(df, target, percent, least).collect()), key=str)
        assert got == brute(plain, TARGET, percent, least)


def test_copies_and_null_keys(spark):
    docs = [(k, "one text of many copies " * 6) for k in range(300)] + [(None, "another text " * 12)] * 3 + [(5, "word " * k) for k in range(15, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("text word",)], "text string")
    got = sorted((tuple(r) for r in R.resample(df, target, 40).collect()), key=str)
    assert got == brute(docs, ["text word"], 40)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert R.resample(none, some).count() == 0
    assert [tuple(r) for r in R.resample(some, none, 100).collect()] == brute([(1, "a b c " * 20)], [], 100)


def test_stretches_give_the_whole_text(monkeypatch):
    text = "Ab cd, éf gh" * 40 + "x" * 99 + " 1 2"
    whole = Counter(x for _, f in R.features(text, 1 << 40) for x in f.tolist())
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(R, "STRETCH", size)
        parts = list(R.features(text, 1 << 40))
        assert Counter(x for _, f in parts for x in f.tolist()) == whole
        assert sum(n for n, _ in parts) == len(R.WORD.findall(text.encode().lower()))
