"""Assembled documents and erasure against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from tessella.operators import assembly as A
from tessella.operators import erasure as E


def plain_closure(tables, keys, refs, seeds):
    """Row numbers that go, found by going over all references until nothing changes."""
    key = lambda t, row: tuple(row[c] for c in keys[t])
    gone = {t: {key(t, r) for r in rows if key(t, r) in seeds.get(t, set())} for t, rows in tables.items()}
    named = lambda row, columns: None if any(row[c] is None for c in columns) else tuple(row[c] for c in columns)
    while True:
        before = {t: len(g) for t, g in gone.items()}
        for r in refs:
            if r.rule == "cascade":
                dead = {named(p, r.parent_columns) for p in tables[r.parent] if key(r.parent, p) in gone[r.parent]} - {None}
                gone[r.child] |= {key(r.child, c) for c in tables[r.child] if named(c, r.columns) in dead}
        for parent in {r.parent for r in refs if r.rule == "orphan"}:
            lost = {}
            for r in [r for r in refs if r.rule == "orphan" and r.parent == parent]:
                for p in tables[parent]:
                    mine = [key(r.child, c) for c in tables[r.child] if named(c, r.columns) is not None and named(c, r.columns) == named(p, r.parent_columns)]
                    a, b = lost.get(key(parent, p), (False, False))
                    lost[key(parent, p)] = (a or any(k in gone[r.child] for k in mine), b or any(k not in gone[r.child] for k in mine))
            gone[parent] |= {k for k, (a, b) in lost.items() if a and not b}
        if before == {t: len(g) for t, g in gone.items()}:
            return gone


REFS = [
    E.Ref("post", ("topic",), "topic", ("id",)),
    E.Ref("post", ("answers",), "post", ("id",)),  # a table that names itself
    E.Ref("post", ("topic",), "topic", ("id",), "orphan"),  # and a cycle with the first
    E.Ref("mark", ("post", "place"), "post", ("id", "place")),
    E.Ref("mark", ("label",), "label", ("id",), "orphan"),
    E.Ref("note", ("label",), "label", ("id",), "orphan"),  # a label goes when neither names it
    E.Ref("note", ("post",), "post", ("id",), "mask"),
]
KEYS = {"topic": ["id"], "post": ["id"], "mark": ["post", "place", "label"], "label": ["id"], "note": ["n"]}
SCHEMAS = {"topic": "id int", "post": "id int, topic int, answers int, place string", "mark": "post int, place string, label int", "label": "id int", "note": "n int, label int, post int"}


def forum(seed, hot):
    rng = random.Random(seed)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    posts = [(k, 0 if hot and k % 3 == 0 else some(12), None if k == 0 or rng.random() < 0.6 else rng.randrange(k), rng.choice("xyz")) for k in range(90)]
    marks = [(some(90), rng.choice("xyz"), some(90)) for _ in range(120)]
    return {"topic": [(k,) for k in range(12)], "post": posts, "mark": marks + marks[:5], "label": [(k,) for k in range(90)], "note": [(k, some(90), some(90)) for k in range(40)]}


@pytest.mark.parametrize(("seed", "hot"), [(1, False), (2, True)])
def test_closure(spark, seed, hot):
    rows = forum(seed, hot)
    named = {t: [dict(zip([c.split()[0] for c in SCHEMAS[t].split(", ")], r, strict=True)) for r in rs] for t, rs in rows.items()}
    tables = {t: spark.createDataFrame(rs, SCHEMAS[t]) for t, rs in rows.items()}
    seeds = {"topic": {(0 if hot else 3,)}, "post": {(9,), (40,), (999,)}}
    asked = {t: spark.createDataFrame([*s], "id int") for t, s in seeds.items()}
    gone = E.closure(tables, KEYS, REFS, asked)
    want = plain_closure(named, KEYS, REFS, seeds)
    for t in tables:
        assert {tuple(r) for r in gone[t].select(*KEYS[t]).collect()} == want[t], t
    assert len(want["post"]) > 2 and want["mark"] and want["label"]
    left = E.erased(tables, KEYS, REFS, gone)
    for t in ("post", "mark"):
        at = [list(named[t][0]).index(c) for c in KEYS[t]]
        assert sorted(map(repr, (tuple(r) for r in left[t].collect()))) == sorted(repr(r) for r in rows[t] if tuple(r[k] for k in at) not in want[t])
    posts = {k for (k,) in want["post"]}
    assert {tuple(r) for r in left["note"].collect()} == {(n, lab, None if p in posts else p) for n, lab, p in rows["note"]}


def test_closure_of_nothing(spark):
    tables = {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
    gone = E.closure(tables, KEYS, REFS[:4], {"topic": spark.createDataFrame([(1,)], "id int")})
    assert all(g.count() == 0 for g in gone.values())


def test_a_long_chain_and_null_keys(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(8)] + [(None, 3), (20, 19)], "id int, up int")
    gone = E.closure({"t": chain}, {"t": ["id"]}, [E.Ref("t", ("up",), "t", ("id",))], {"t": spark.createDataFrame([(2,)], "id int")})
    assert {r.id for r in gone["t"].collect()} == {2, 3, 4, 5, 6, 7, None}


BOOK = {"order": "id int, who int", "line": "of int, n int"}


def test_children_and_parents_that_went_together_are_not_asked_again(spark, monkeypatch):
    rows = {"order": [(k, k % 4) for k in range(40)], "line": [(k % 40, k) for k in range(120)] + [(3, 1000), (3, 1000)]}
    refs = [E.Ref("line", ("of",), "order", ("id",)), E.Ref("line", ("of",), "order", ("id",), "orphan")]
    joined = []
    meet = E._meet
    monkeypatch.setattr(E, "_meet", lambda left, columns, right, how, safe=False: (joined.append((tuple(columns), how)), meet(left, columns, right, how, safe))[1])
    gone = E.closure({t: spark.createDataFrame(r, BOOK[t]) for t, r in rows.items()}, {"order": ["id"], "line": ["of", "n"]}, refs, {"order": spark.createDataFrame([(3,), (7,)], "id int")})
    assert {r.id for r in gone["order"].collect()} == {3, 7}
    assert sorted(map(tuple, gone["line"].collect())) == sorted({r for r in rows["line"] if r[0] in (3, 7)})
    # the seeds' orders, then their lines: no join by the lines' whole key, none of lines with orders that are gone
    assert joined == [(("id",), "left_semi"), (("of",), "left_semi")]


def test_rows_that_share_a_key_and_name_others(spark):
    rows = {"order": [(k,) for k in range(4)], "line": [(1, 0), (1, 1), (2, 2), (3, 2), (4, 3)]}  # n, of: number 1 names two orders
    refs = [E.Ref("line", ("of",), "order", ("id",)), E.Ref("line", ("of",), "order", ("id",), "orphan")]
    tables = {"order": spark.createDataFrame(rows["order"], "id int"), "line": spark.createDataFrame(rows["line"], "n int, of int")}
    gone = E.closure(tables, {"order": ["id"], "line": ["n"]}, refs, {"order": spark.createDataFrame([(0,)], "id int"), "line": spark.createDataFrame([(2,)], "n int")})
    assert {r.id for r in gone["order"].collect()} == {0, 1} and {r.n for r in gone["line"].collect()} == {1, 2}


def inputs(spark, most=3):
    rng = random.Random(4)
    rows = [(7 if k % 3 == 0 else rng.randrange(9), k, f"v{k % 5}") for k in range(200)] + [(None, 500, "x"), (77, 501, None)]
    df = spark.createDataFrame(rows, "owner int, n int, v string").repartition(6)
    return rows, [A.many(df, "owner", "listed", [F.col("n"), F.col("v")], [F.desc("n")], most), A.folded(df, "owner", "sums", [F.count("*").alias("rows"), F.max("n").alias("top")]), A.one(df, "owner", "last", [F.col("v")], ["n"])]


def test_documents(spark):
    rows, made = inputs(spark)
    base = spark.createDataFrame([(k, f"t{k}") for k in range(10)] + [(None, "lost")], "id int, title string")
    got = A.assemble(base, "id", made, volatile=["last"]).collect()
    assert len(got) == 11 and len({r.digest for r in got}) == 11
    for r in got:
        mine = sorted(((n, v) for o, n, v in rows if o is not None and o == r.id), reverse=True)
        if not mine:
            assert (r.listed, r.sums, r["last"]) == (None, None, None)
            continue
        assert [tuple(x) for x in r.listed["items"]] == mine[:3] and r.listed.partial == (len(mine) > 3)
        assert tuple(r.sums) == (len(mine), mine[0][0]) and r["last"].v == mine[0][1]


def test_only_what_is_not_volatile_changes_a_digest(spark):
    def digest(title, seen):
        base = spark.createDataFrame([(1, title, seen)], "id int, title string, seen string")
        return A.assemble(base, "id", inputs(spark)[1], volatile=["seen"]).first().digest

    assert digest("a", "mon") == digest("a", "tue") != digest("b", "mon")


def test_one_exchange_an_input(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = inputs(spark)[1]
        made = [m.withColumnRenamed(m.columns[1], f"i{k}") for k, m in enumerate(made)]
        base = spark.range(10).withColumnRenamed("id", "key")
        plan = A.assemble(base, "key", made)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_key") == len(made) + 1
        assert plan.count("WindowGroupLimit") == 2  # few rows of a key leave a task
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
