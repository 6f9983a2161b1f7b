"""The search index against plain versions, what it reads, and runs that die halfway."""

import math
import random
import re

import pytest
from tessella.operators import postings as P
from tessella.sources.tables import Commits, fresh

SHAPE = "doc_id long, title string, body string, kind string"


def table(n=300, seed=5, other=0.0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Apache", "license", "version", "licence"]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = []
    for i in range(n):
        said = lambda k: " ".join(rng.choices(words, weights, k=k))
        title, body = said(rng.randint(0, 5)), said(rng.randint(0, 60)) if i % 9 else None
        out.append((i, title, body + " apache license" if body and rng.random() < 0.1 else body, "k"))
    return out


def tokens(row):
    return [re.findall("[0-9a-z]+", (x or "").lower()) for x in row[1:3]]


def plain_top(rows, terms, k, weights, k1=1.2, b=0.75):
    toks = {r[0]: tokens(r) for r in rows}
    n, mean = len(rows), sum(map(len, sum(toks.values(), []))) / len(rows)
    df = {t: sum(t in x + y for x, y in toks.values()) for t in terms}
    idf = {t: max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0) or 1e-6 for t in terms}
    out = []
    for i, (x, y) in toks.items():
        tf = {t: weights[0] * x.count(t) + weights[1] * y.count(t) for t in terms}
        if all(t in x + y for t in terms):
            out.append((round(-sum(idf[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(x + y) / mean)) for t in terms), 6), i))
    return sorted(out)[:k]


@pytest.fixture(scope="module")
def index(spark):
    made = P.Index(spark, fresh(spark, "index"), shift=3)  # eight documents a block: many blocks
    counts = made.refresh(spark.createDataFrame(table(), SHAPE).repartition(3), "doc_id", ["title", "body"], ["kind"], lots=12)
    assert counts == {"new": 300, "changed": 0, "gone": 0}
    return made


def ids(index, rows):
    return sorted(r.doc_id for r in index.keyed(rows).collect())


def test_boolean_searches(index):
    toks = {r[0]: tokens(r) for r in table()}
    both = {i: x + y for i, (x, y) in toks.items()}
    assert ids(index, index.search(["w3", "license"], none=["w5"])) == sorted(i for i, w in both.items() if "w3" in w and "license" in w and "w5" not in w)
    assert ids(index, index.search(["licen*"])) == sorted(i for i, w in both.items() if any(x.startswith("licen") for x in w))
    assert ids(index, index.search([], some=["w40", "version"])) == sorted(i for i, w in both.items() if "w40" in w or "version" in w)
    near = lambda w, p: any(w[k : k + len(p)] == p for k in range(len(w)))
    for phrase in ("apache license", "w1 w1", "w0 w1 w2"):
        assert ids(index, index.having(phrase)) == sorted(i for i, (x, y) in toks.items() if near(x, phrase.split()) or near(y, phrase.split()))
    assert ids(index, index.having("w2", column=0)) == sorted(i for i, (x, _) in toks.items() if "w2" in x)
    assert ids(index, index.having("nothing")) == []


@pytest.mark.parametrize("terms,weights", [(["license"], [1.0, 1.0]), (["w0", "w7"], [10.0, 1.0]), (["w50", "license"], [3.0, 0.5]), (["w0", "nothing"], [1.0, 1.0])])
def test_top_is_that_of_scoring_all(index, terms, weights):
    for k, probe in ((5, 1), (40, 2), (1000, 16)):
        got = sorted((r.score, r.doc_id) for r in index.top(terms, k, weights, probe=probe).collect())
        assert [(pytest.approx(s, abs=2e-6), i) for s, i in plain_top(table(), terms, k, weights)] == got


def test_a_query_reads_the_lots_of_its_terms(index):
    """No file but those of one lot for each term, and a filter on the term that reaches them."""
    lots = {f.rpartition("lot=")[2].split("/")[0] for f in index.of(["license", "w3"]).inputFiles()}
    everything = {f.rpartition("lot=")[2].split("/")[0] for s in index.state["segments"] for f in index._folder(s).inputFiles()}
    assert 1 <= len(lots) <= 2 < len(everything)
    plan = index.of(["license"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,license)]" in plan


def test_blocks_are_skipped(spark, monkeypatch):
    made = P.Index(spark, fresh(spark, "index"), shift=3)
    rows = [(i, "", "word " * (60 if i == 78 else i % 3 == 0) + "other " * 60, "k") for i in range(400)]
    made.refresh(spark.createDataFrame(rows, SHAPE).repartition(2), "doc_id", ["title", "body"], ["kind"])
    opened, was = [], made._opened
    monkeypatch.setattr(made, "_opened", lambda rows: (opened.append(rows.count()), was(rows))[1])
    assert [r.doc_id for r in made.top(["word"], 1, probe=1).collect()] == [78]
    assert made.of(["word"]).count() >= 40 and len(opened) == 2 and max(opened) <= 2


def test_refresh_and_compact(spark):
    made = P.Index(spark, fresh(spark, "index"))
    first = table(120)
    made.refresh(spark.createDataFrame(first, SHAPE), "doc_id", ["title", "body"])
    then = [r for r in first if r[0] % 7] + [(r[0] + 1000, *r[1:]) for r in first[:20]]
    then = [(r[0], r[1], "quite new license words", r[3]) if r[0] % 5 == 0 else r for r in then]
    was = {r.doc_id: r.rowid for r in made.documents().collect()}
    counts = made.refresh(spark.createDataFrame(then, SHAPE), "doc_id", ["title", "body"])
    old = {r[0]: r for r in first}
    assert counts["gone"] == len([r for r in first if r[0] % 7 == 0]) and counts["new"] == 20
    assert counts["changed"] == sum(r[0] in old and r[1:3] != old[r[0]][1:3] for r in then)
    for _ in range(2):  # with dead entries, then without
        again = P.Index(spark, made.path)  # as another run finds it
        assert all(was[r.doc_id] == r.rowid for r in again.documents().collect() if r.doc_id in was)
        assert ids(again, again.having("new license")) == sorted(r[0] for r in then if (r[2] or "").startswith("quite new"))
        got = sorted((r.score, r.doc_id) for r in again.top(["license", "w0"], 30, [2.0, 1.0]).collect())
        assert [(pytest.approx(s, abs=2e-6), i) for s, i in plain_top(then, ["license", "w0"], 30, [2.0, 1.0])] == got
        made.compact()
        assert len(made.state["segments"]) == 1 and made.state["dead"] is None
    assert made.refresh(spark.createDataFrame(then, SHAPE), "doc_id", ["title", "body"]) == {"new": 0, "changed": 0, "gone": 0}


def test_a_run_that_dies_leaves_the_last_state(spark, monkeypatch):
    made = P.Index(spark, fresh(spark, "index"))
    made.refresh(spark.createDataFrame(table(40), SHAPE), "doc_id", ["title", "body"])
    before = ids(made, made.having("license"))
    broken = P.Index(spark, made.path)
    monkeypatch.setattr(broken, "_deal", lambda *a: 1 / 0)
    more = spark.createDataFrame(table(40) + [(900, "license", None, None)], SHAPE)
    with pytest.raises(ZeroDivisionError):
        broken.refresh(more, "doc_id", ["title", "body"])
    again = P.Index(spark, made.path)
    assert ids(again, again.having("license")) == before
    assert again.refresh(more, "doc_id", ["title", "body"])["new"] == 1
    assert ids(again, again.having("license")) == sorted([*before, 900])
    with pytest.raises(RuntimeError):
        Commits(spark, made.path).commit(again.number, {})


def test_empty_index(spark):
    made = P.Index(spark, fresh(spark, "index"))
    made.refresh(spark.createDataFrame([], SHAPE), "doc_id", ["title", "body"])
    assert made.keyed(made.having("x")).count() == 0 and made.top(["x"], 3).count() == 0


def test_dead_entries_are_taken_out_many_postings_at_a_time(monkeypatch):
    """Before, each posting was opened and packed on its own, some 0.3 ms each."""
    import numpy as np
    import pyarrow as pa

    texts = [[f"all {k % 7} x{k % 3}".encode(), b"all of it"] for k in range(32)]
    batch = P._postings(list(range(32)), texts, 2, [], 3)
    dead = {0: {1, 3}, 1: set(range(8)), 2: {7}}  # by block; of the last none
    bits = [bytes([sum(1 << p for p in dead[b])]) if b in dead else None for b in batch.column("block").to_pylist()]
    calls, was = [], P.unpacked
    monkeypatch.setattr(P, "unpacked", lambda data: (calls.append(1), was(data))[1])
    got = pa.Table.from_batches(list(P._without_dead(2, 3, ["it"])(iter([batch.append_column("dead", pa.array(bits, pa.binary()))]))))
    assert len(calls) == 1
    live = [k for k in range(32) if k % 8 not in dead.get(k // 8, ())]
    want = pa.Table.from_batches([P._postings(live, [texts[k] for k in live], 2, ["it"], 3)])
    rows = lambda t: sorted(map(tuple, zip(*(t.column(c).to_pylist() for c in want.column_names), strict=True)))
    assert rows(got) == rows(want) and np.all(np.array(got.column("n")) > 0)


def test_memory_of_a_word_while_postings_are_made():
    """Before, 326 bytes a word stood at once, with 64-bit numbers throughout."""
    import tracemalloc

    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    texts = [[b"", " ".join(rng.choices(words, k=400)).encode()] for _ in range(500)]
    tracemalloc.start()
    P._postings(list(range(500)), texts, 2, [], 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / 200_000 < 260
