"""Rules, path patterns and block fill against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tessella.operators import fill as B
from tessella.operators import paths as A
from tessella.operators import rules as C

RULES = [(1, "topic", "a", 1.0, "red fox"), (2, "topic", "b", 0.5, "fox"), (3, "kind", "c", 2.0, "dig*"), (4, "kind", "d", 1.0, "fox red"), (5, "kind", "d", 1.0, " "), (6, "kind", "c", 1.0, None), (7, "topic", "b", 1.0, "Fox-fox")]


def rule_table(spark):
    return spark.createDataFrame(RULES, "rule long, facet string, value string, weight double, phrase string")


def test_matches_count_every_place(spark):
    docs = spark.createDataFrame([(1, "Red fox red fox. We dig, digging fox fox fox", None), (2, "", "foxes red-fox"), (3, None, None), (4, "x" * 100_000 + " fox", "dig")], "k int, a string, b string")
    got = {(r.key, r.field, r.rule): (r.n, r.amount) for r in C.matches(docs, rule_table(spark), "k", ["a", "b"]).collect()}
    assert got == {(1, "a", 1): (2, 2.0), (1, "a", 2): (5, 5.0), (1, "a", 4): (1, 1.0), (1, "a", 3): (2, 2.0), (1, "a", 7): (2, 2.0), (2, "b", 1): (1, 1.0), (2, "b", 2): (1, 1.0), (4, "a", 2): (1, 1.0), (4, "b", 3): (1, 1.0)}
    own = C.matches(docs, rule_table(spark), "k", ["a"], own=r"\bwe\b").filter("key = 1")
    assert {r.rule: r.amount for r in own.collect()} == {1: 1.0, 2: 1.0 + 3.0, 4: 0.5, 3: 2.0, 7: 2.0}
    assert C.matches(docs, rule_table(spark).limit(0), "k", ["a"]).count() == 0


def test_background_sentences():
    own = re.compile("we")
    assert C.sentence_weights(["x", "we", "y", "z"], own) == [0.5, 1, 1, 1]
    assert C.sentence_weights(["x", "y", "z", "we"], own) == [1, 1, 1, 1]
    assert C.sentence_weights(["we", "y"], own) == [1, 1] and C.sentence_weights([], own) == []


def test_choices(spark):
    rows = [(1, "topic", "a", 0.9), (1, "topic", "b", 0.6), (2, "topic", "a", 0.9), (2, "topic", "b", 0.8), (3, "topic", "a", 0.2), (4, "kind", "none", 0.9), (4, "kind", "c", 0.7), (5, "kind", "none", 0.6), (5, "kind", "c", 0.7)]
    got = C.decided(spark.createDataFrame(rows, "key int, facet string, value string, confidence double"), ["topic"], exclusive={"kind": "none"}).collect()
    assert {(r.key, r.value) for r in got if r.chosen} == {(1, "a"), (2, "a"), (4, "none"), (5, "c")}
    assert {r.key for r in got if r.ambiguous} == {2, 3}


def test_a_model_settles_what_rules_leave_open(spark):
    rules = spark.createDataFrame([(1, "topic", "a", 0.9, True, False), (2, "topic", "a", 0.9, True, True), (3, "topic", "a", 0.2, False, True)], "key int, facet string, value string, confidence double, chosen boolean, ambiguous boolean")
    said = spark.createDataFrame([(1, "topic", "Bee"), (2, "topic", " big_Bee "), (2, "topic", "what"), (3, "topic", "what")], "key int, facet string, said string")
    words = spark.createDataFrame([("topic", "bee", "b"), ("topic", "big bee", "b")], "facet string, alias string, value string")
    got = C.overriding(rules, said, words).collect()
    assert {(r.key, r.value, r.by) for r in got} == {(1, "a", "rules"), (2, "b", "model")}


CASES = [
    ("*.js", ["a.js", "x/y.js"], ["a.jsx", "js"]),
    ("/docs/", ["docs/a", "docs/b/c"], ["docs", "x/docs/a"]),
    ("docs/*", ["docs/a"], ["docs/a/b", "x/docs/a"]),
    ("apps/", ["apps/a", "x/apps/b/c"], ["apps"]),
    ("**/logs", ["logs", "a/logs", "a/b/logs/x"], ["logsx"]),
    ("/a/**/z", ["a/z", "a/b/z", "a/b/c/z/y"], ["b/a/z"]),
    ("src/**", ["src/a", "src/a/b"], ["src", "x/src/a"]),
    ("file?.txt", ["file1.txt", "d/fileA.txt"], ["file.txt", "file12.txt"]),
    ("a+b(c)", ["a+b(c)", "x/a+b(c)/d"], ["aab(c)"]),
    ("/", ["anything/at/all"], []),
    ("!x", [], ["x", "!x"]),
    ("[ab]", [], ["a", "[ab]"]),
    ("\\#x", ["#x"], ["x"]),
    ("a/*/b/**/c*.md", ["a/1/b/c.md", "a/1/b/2/3/cd.md"], ["a/b/c.md", "a/1/2/b/c.md"]),
]


def test_patterns(spark):
    """Each rule alone, through the join: what it owns and what it does not."""
    rules = spark.createDataFrame([(k, p) for k, (p, *_) in enumerate(CASES)], "place long, pattern string")
    paths = spark.createDataFrame([(x,) for _, yes, no in CASES for x in yes + no] + [(None,), ("",)], "path string")
    for k, (_, yes, no) in enumerate(CASES):
        got = {r.path for r in A.last_match(paths, rules.filter(F.col("place") == k), "path").collect() if r.place is not None}
        assert set(yes) <= got and not got & set(no), CASES[k]


def test_the_last_rule_wins_among_all(spark):
    """As testing every rule on every path."""
    rng = random.Random(3)
    names = ["a", "b", "src", "x.js", "y.txt", "docs", "z9"]
    patterns = ["/".join(rng.choice(names + ["*", "**", "?", "*.js", "z*"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"]) for _ in range(60)]
    patterns = [rng.choice(["", "/"]) + p for p in patterns]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(150)})
    rules = spark.createDataFrame(list(enumerate(patterns)), "place long, pattern string")
    regexes = [r[0] for r in rules.orderBy("place").select(A.glob_regex(F.col("pattern"))).collect()]
    want = {p: max((k for k, x in enumerate(regexes) if x and re.match(x, p)), default=None) for p in paths}
    got = A.last_match(spark.createDataFrame([(p,) for p in paths], "path string"), rules, "path").collect()
    assert {r.path: r.place for r in got} == want and len(got) == len(paths)


@pytest.mark.parametrize("most,sizes", [(10, (0, 4)), (7, (0, 12)), (100, (1, 3)), (5, (5, 9)), (3, (0, 0))])
def test_fill_is_the_plain_loop(spark, most, sizes, monkeypatch):
    monkeypatch.setattr(B, "STRETCH", 2)
    monkeypatch.setattr(B, "RUN", 7)
    rng = random.Random(most)
    items = [(k, rng.randint(*sizes)) for k in range(120)]
    want, used, block = {}, 0, 0
    for k, s in items:
        if k and used + s > most:
            used, block = 0, k
        used += s
        want[k] = block
    df = spark.createDataFrame(items, "k long, size long").repartition(3)
    assert {r.k: r.block for r in B.filled(df, ["k"], "size", most).collect()} == want
    assert B.filled(df.limit(0), ["k"], "size", most).count() == 0


def test_batches_are_taken_in_stretches_of_bytes():
    """Before, a whole Arrow batch of 10,000 texts and all its matches stood in Python at once."""
    import pyarrow as pa
    from tessella.sources.tables import in_parts, sizes

    texts = ["x" * 10] * 50 + [None] + ["y" * 500] + ["é" * 10] * 10
    batch = pa.RecordBatch.from_pydict({"k": list(range(62)), "t": texts})
    parts = list(in_parts(batch, sizes(batch.column("t")), 100))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert all(sum(len((x or "").encode()) for x in p.column("t").to_pylist()) <= 100 or p.num_rows == 1 for p in parts)
    assert len(parts) > 7 and not list(in_parts(batch.slice(0, 0), sizes(batch.column("t").slice(0, 0)), 100))
