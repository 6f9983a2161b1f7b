"""Repeated passages against brute force, and the pipeline against its stages' meaning."""

import random
import re

import numpy as np

from tessella.llm.passages import compact_windows, drop_repeats, repeats

from .fixtures import SCHEMA, frame, rows


def split(t):
    return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def test_compact_windows():
    rng = np.random.default_rng(1)
    for t in (3, 7, 16):
        texts = [rng.integers(1, 30, n).astype(np.uint64) for n in (40, 5, 120, 1)]
        a = np.concatenate([np.concatenate((np.zeros(1, np.uint64), x)) for x in texts] + [np.zeros(1, np.uint64)])
        got = set(zip(*(x.tolist() for x in compact_windows(a, t, 120)), strict=True))
        want = set()
        for c in np.flatnonzero(a):
            lo, hi = c, c + 1
            while a[lo - 1] > a[c]:
                lo -= 1
            while a[hi] >= a[c]:
                hi += 1
            if hi - lo >= t:
                want.add((int(c), int(lo), int(hi)))
        assert got == want


def planted(seed=2):
    rng = random.Random(seed)
    vocab = [f"{rng.choice('abcdefgh')}{k}é" for k in range(3000)]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    shared, long_ = words(60), words(300)
    line = words(12)
    out = []
    for k in range(30):
        out.append(words(rng.randint(20, 200)) + (shared if k % 3 == 0 else []) + words(rng.randint(0, 60)) + line)
    for _ in range(3):
        near = list(long_)
        for j in range(10, 300, 60):
            near[j] = rng.choice(vocab)
        out.append(words(30) + near)
    out.append(shared[:49] + words(5))
    return [" ".join(w) for w in out]


def brute(data, least=50):
    """Documents with an exact run of ``least`` words that a smaller id has."""
    first, out = {}, set()
    for i, t in sorted((r[0], r[1]) for r in data if r[1]):
        w = split(t)
        for k in range(len(w) - least + 1):
            g = tuple(w[k : k + least])
            if first.setdefault(g, i) != i:
                out.add(i)
    return out


def test_repeats(spark):
    extra = planted()
    data = rows(extra)
    df = frame(spark, extra)
    got = repeats(df).collect()
    text = {r[0]: r[1] for r in data}
    base = max(text) - len(extra) + 1
    found = {r.doc_id for r in got}
    assert brute(data) <= found
    assert {base + 31, base + 32} <= found and base + 33 not in found  # near repeats; 49 words only
    assert all(base + k not in found for k in range(30) if k % 3)
    for r in got:
        assert r.source_id < r.doc_id and r.similarity >= 0.8
        here, there = text[r.doc_id][r.start : r.end], text[r.source_id][r.source_start : r.source_end]
        assert len(split(here)) == r.n_words >= 50
        if r.similarity == 1.0 and len(split(here)) == len(set(split(here))):
            assert set(split(here)) == set(split(there))
    assert repeats(df.limit(0)).count() == 0


def test_dropping_repeats(spark):
    extra = planted()
    df = frame(spark, extra)
    got = drop_repeats(df)
    assert got.columns == df.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    text = {r[0]: r[1] for r in rows(extra)}
    base = max(text) - len(extra) + 1
    shared = split(text[base])  # the first holder keeps its passage
    assert kept[base] == text[base]
    for k in range(3, 30, 3):
        assert kept[base + k] != text[base + k] and not brute([(0, " ".join(shared)), (1, kept[base + k])])
    assert all(kept[base + k] == text[base + k] for k in range(30) if k % 3)
    assert brute([(i, t) for i, t in kept.items()]) == set()
    assert None in [kept[i] for i in text if text[i] is None and i in kept]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [(i, t, "en", "s", 1) for i, t, *_ in rows(planted())]
    data.append((9999, 'a few words, then token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more', "en", "s", 1))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) or name == "language_id"
        assert set(ids) <= before
        before = set(ids)
    assert [r.text for r in docs.filter("doc_id = 9999").collect()] == ['a few words, then [secret]" and more']
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == before
    assert all(r.length <= 4096 for r in out)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def numbered(name, n):
    return [f"{name}{k}" for k in range(n)]


def found(spark, texts):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.source_id) for r in repeats(df).collect()}


def test_common_lines_hide_no_passage(spark):
    """Two texts share a passage of which every long stretch stands elsewhere in other surroundings, before and after."""
    p = numbered("p", 55)
    parts = [p[k : k + 35] for k in (0, 10, 20)]
    around = [numbered(f"a{k}x", 30) + parts[k % 3] + numbered(f"b{k}x", 30) for k in range(6)]
    texts = [*around[:3], numbered("c", 40) + p + numbered("d", 40), numbered("e", 40) + p + numbered("f", 40), *around[3:]]
    assert found(spark, texts) == {(4, 3)}


def test_families_that_drift(spark):
    """Each text is like the one before it (0.8) and unlike the first, and all share lines."""
    base = numbered("w", 300)
    texts = []
    for k in range(6):
        base = [f"v{k}y{i}" if i % 50 == 8 * k else w for i, w in enumerate(base)]
        texts.append(list(base))
    got = found(spark, texts)
    assert {d for d, _ in got} == {1, 2, 3, 4, 5}


def test_inner_lines_do_not_part_passages(spark):
    line, p = numbered("l", 12), numbered("p", 30)
    inner = p + line + numbered("q", 20)
    at_start = line + numbered("s", 45)
    a = [numbered("a", 30) + line + numbered("b", 20) + inner, numbered("c", 30) + inner + numbered("d", 9)]
    b = [numbered("e", 30) + line + numbered("f", 20) + at_start, numbered("g", 30) + at_start + numbered("h", 9)]
    twice = [numbered("i", 70), numbered("j", 20) + numbered("i", 70) + numbered("k", 20) + numbered("i", 70)]
    for texts, sizes in ((a, [62]), (b, [57]), (twice, [70, 70])):
        df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
        assert [r.n_words for r in repeats(df).collect()] == sizes


def test_one_edit_is_never_missed(spark):
    """Passages at 0.8 and little more, each with one word changed in the middle."""
    rng = random.Random(4)
    texts = [numbered(f"q{k}x", 52) for k in range(150)]
    copies = [numbered(f"r{k}x", 25) + [w if i != at else "changed" for i, w in enumerate(t)] for k, t in enumerate(texts) for at in [rng.randint(22, 30)]]
    got = found(spark, texts + copies)
    assert got == {(150 + k, k) for k in range(150)}
