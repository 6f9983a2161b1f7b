"""The operators on small cases, with results told by hand or by plain Python."""

import datetime as dt
import json
import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import delta as D
from tessella.operators import relational as R
from tessella.operators import search as Q
from tessella.operators import series as T
from tessella.sources import files as IO
from tessella.streaming import events as E


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {'double' if isinstance(inputs[0], float) else 'long' if isinstance(inputs[0], int) else 'string'}")
    return [r.v for r in rows.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def test_day_keys(spark):
    assert values(spark, S.day_key, "2026", "2026-09", "2026-09-21", "", "soon", None) == [20260000, 20260900, 20260921, None, None, None]
    assert values(spark, lambda c: S.day_key(c, True), "2026", "2026-09") == [20269999, 20260999]


def test_contacts(spark):
    assert values(spark, S.mask_emails, "write to a.b@x.org, or c@y.co.uk.", "no one") == ["write to [email], or [email].", "no one"]
    assert values(spark, S.has_contact, "a@b.org", "a at b") == [True, False]
    assert values(spark, S.email_digest, " A@b.org ")[0] == hashlib.sha256(b"a@b.org").hexdigest()


def test_identifiers(spark):
    text = "héllo\n"
    raw = text.encode()
    assert values(spark, S.content_id, text) == ["swh:1:cnt:" + hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()]
    assert values(spark, S.shard, "a/b", "x") == [hashlib.sha256(k).digest()[0] % 64 for k in (b"a/b", b"x")]
    assert values(spark, S.check_11_2, "0000000218250097", "0000000218250098", "12") == [True, False, False]
    assert values(spark, S.doi, "see https://doi.org/10.1234/AB.c.", "none") == ["10.1234/ab.c", ""]
    assert values(spark, S.package_name, "A_b--c.D") == ["a-b-c-d"]
    r = values(spark, S.requirement, "Py_Thing[x,y] >= 1.2, <2 ; python_version>'3'")[0]
    assert (r.name, r.extras, r.constraint) == ("py-thing", "x,y", ">= 1.2, <2")


def test_versions_sort(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "v2.0.0+b7"]
    rows = spark.createDataFrame([(v,) for v in order[::-1]], "v string")
    assert [r.v for r in rows.orderBy(S.semver_key(F.col("v"))).collect()] == order


def test_small_expressions(spark):
    assert values(spark, S.severity, 9.8, 7.0, 4.1, 0.1, 0.0) == ["critical", "high", "medium", "low", "none"]
    t = values(spark, S.task_progress, "- [x] a\n* [ ] b\n- [X] c\n- d")[0]
    assert (t.done, t.total) == (2, 3)
    assert values(spark, S.hidden_characters, "a‮b​c", "plain") == [2, 0]
    assert values(spark, S.relative_time, 5, 60, 7200, 200000) == ["just now", "1 minute ago", "2 hours ago", "2 days ago"]
    assert values(spark, lambda c: S.count_condition(c, "1..*"), 0, 1, 99) == [False, True, True]
    assert values(spark, lambda c: S.count_condition(c, "nonsense"), 1) == [False]
    assert values(spark, S.links, "see (https://a.org/x), and http://b.org.") == [["https://a.org/x", "http://b.org"]]
    u = values(spark, S.url_parts, "https://www.Host.org/me/tool.git?x=1")[0]
    assert (u.host, u.owner, u.name) == ("host.org", "me", "tool")


def test_kept_events(spark):
    hours = [0, 20, 40, 41, 70]
    rows = [("a", k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for k, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "who string, id long, ts timestamp")
    got = {r.id for r in T.kept_events(df, ["who"], "ts", "id", 86400).collect()}
    assert got == {0, 2, 4}  # a comparison with the neighbour alone would lose the third


def test_no_key_is_gathered_whole(spark):
    """Kept events stream by sorted; a ring gathers what it keeps and not a user's every event."""
    rows = [("a" if k % 3 else None, k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k)) for k in range(400)] + [("b", 900, None)]
    df = spark.createDataFrame(rows, "who string, id long, ts timestamp").repartition(5)
    kept = T.kept_events(df, ["who"], "ts", "id", 86400)
    assert "collect_list" not in kept._jdf.queryExecution().toString()
    last, want = {}, {900}
    for who, k, at in rows[:-1]:
        if who not in last or at - last[who] >= dt.timedelta(days=1):
            last[who] = at
            want.add(k)
    assert {r.id for r in kept.collect()} == want

    from tessella.plans.catalogue import QUERIES

    plan = QUERIES["ring_trimmed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("collect_list") < plan.index("WindowGroupLimit")


def test_diversified_streams_in_order(spark):
    from tessella.operators import greedy as G

    rows = [(k % 2, k % 7, k % 11, k % 5, float(k * 37 % 101)) for k in range(300)]
    df = spark.createDataFrame(rows, "paper int, paragraph int, unit int, file int, score double").repartition(4)
    got = G.diversified(df, "paper", "score", {"paragraph": 2, "unit": 2}, ("file", "unit"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    want, used, owner = [], {}, {}
    for p, a, u, f, s in sorted(rows, key=lambda r: (r[0], -r[4], r[1], r[2])):
        if used.get((p, "a", a), 0) < 2 and used.get((p, "u", u), 0) < 2 and owner.get((p, f), u) == u:
            used[p, "a", a], used[p, "u", u], owner[p, f] = used.get((p, "a", a), 0) + 1, used.get((p, "u", u), 0) + 1, u
            want.append((p, a, u, f, s))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_islands_and_versions(spark):
    df = spark.createDataFrame([("a", t, t in (2, 3, 7)) for t in range(10)], "k string, t long, bad boolean")
    assert sorted((r.first, r.last, r.n) for r in T.islands(df, "k", ["t"], F.col("bad"), "t").select("first", "last", "n").collect()) == [(2, 3, 2), (7, 7, 1)]
    v = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "x", "y"), ("a", 3, "z", "y")], "k string, v int, p string, q string")
    assert [(r.v, r.changed) for r in T.version_diff(v, "k", "v", ["p", "q"]).orderBy("v").collect()] == [(2, "q"), (3, "p")]


def test_budget_stops_at_the_first_row_too_many(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 1)], "k string, o int, cost int")
    assert [r.sent for r in T.budget_cut(df, ["k"], ["o"], "cost", 10).orderBy("o").collect()] == [True, False, False]


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, x string, y string")
    new = spark.createDataFrame([(2, "", "r"), (3, "c", None)], "k int, x string, y string")
    assert sorted(tuple(r) for r in D.upsert(old, new, ["k"], True).collect()) == [(1, "a", "p"), (2, "b", "r"), (3, "c", None)]
    assert sorted(tuple(r) for r in D.upsert(old, new, ["k"]).collect()) == [(1, "a", "p"), (2, "", "r"), (3, "c", None)]
    assert sorted(r.k for r in D.insert_or_ignore(old, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted(tuple(r) for r in D.replace_partition(old, new, "k").select("k", "x").collect()) == [(1, "a"), (2, ""), (3, "c")]
    a, b = old.withColumn("digest", D.row_hash("x", "y")), new.withColumn("digest", D.row_hash("x", "y"))
    assert sorted(tuple(r) for r in D.delta(a, b, "k").collect()) == [(1, "deleted"), (2, "changed"), (3, "new")]


def test_overlaps_and_similarity(spark):
    new = spark.createDataFrame([("f", 1, 10, 20), ("f", 2, 500, 900)], "g string, key long, s long, e long")
    old = spark.createDataFrame([("f", 7, 1, 12), ("f", 8, 15, 40), ("f", 9, 600, 610), ("g", 1, 10, 20)], "g string, key long, s long, e long")
    assert sorted(tuple(r) for r in R.best_overlap(new, old, ["g"], "s", "e", "key").collect()) == [("f", 1, 8, 6), ("f", 2, 9, 11)]
    p = spark.createDataFrame([(d, "w", x) for d, ws in {1: "ab", 2: "abc", 3: "cx", 4: "y"}.items() for x in ws], "d int, kind string, t string")
    got = {(r.doc, r.other) for r in R.similar(p, "d", "kind", "t", {"w": 1.0}, 2, 5, 0.0).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_search(spark):
    d = spark.createDataFrame([(1, "Open source code"), (2, "source, open"), (3, "Openly sourced")], "id int, text string").select("id", Q.tokens(F.col("text")).alias("k"))
    assert [r.id for r in d.filter(Q.has_phrase(F.col("k"), ["open", "source"])).collect()] == [1]
    assert sorted(r.id for r in d.filter(Q.has_prefix(F.col("k"), "open")).collect()) == [1, 2, 3]
    scores = {r.id: r.score for r in Q.bm25(d, "id", "k", ["code"]).collect()}
    assert set(scores) == {1} and scores[1] < 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "=1+1"), ("b", 'say "x"\nnow'), ("c", None)], "k string, v string")
    IO.write_csv(df, f"{tmp_path}/csv")
    back = IO.read_delimited(spark, f"{tmp_path}/csv", "k string, v string")
    assert sorted((r.k, r.v or "") for r in back.collect()) == [("a", "'=1+1"), ("b", 'say "x"\nnow'), ("c", "")]
    IO.write_sharded(df, "k", f"{tmp_path}/lots")
    assert [r.v for r in IO.lookup(spark, f"{tmp_path}/lots", "k", "a").collect()] == ["=1+1"]
    (tmp_path / "x.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in IO.read_json_lines(spark, f"{tmp_path}/x.json", "a int").collect()) == [1, 2]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["c"]}]})
    assert spark.createDataFrame([(nb,)], "raw string").select(IO.notebook_code().alias("c")).first().c == "a = 1\nb\n\nc"
    f = spark.createDataFrame([("r", f"p{k}", 10 * k) for k in range(1, 6)], "repo string, path string, size long")
    assert [r.path for r in IO.read_capped(f, "repo", "path", "size", 45, 3, 100).orderBy("path").collect()] == ["p1", "p2", "p3"]
    known = spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(),)], "digest string")
    t = spark.createDataFrame([("x",), ("y",), ("y",), ("z",)], "text string")
    assert IO.content_blocks(t, known, "text", 100).count() == 2


@pytest.fixture
def stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, "u", "error" if k % 4 == 0 else "view", start + dt.timedelta(hours=10 * k)) for k in range(12)]
    df = spark.createDataFrame(rows, "event_id long, user string, event_type string, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def drain(df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table("out").collect()


def test_stream_of_daily_checks(stream, tmp_path):
    got = {(r.day.day, r.checks, r.ok) for r in drain(E.daily_checks(stream), tmp_path)}
    assert (1, 3, 2) in got and (2, 2, 1) in got


def test_stream_keeps_once(stream, tmp_path):
    assert sorted(r.event_id for r in drain(E.kept_once(stream, "user", "event_id"), tmp_path)) == [0, 3, 6, 9]


def test_stream_into_a_table(stream, spark, tmp_path):
    for turn in (1, 2):  # sent again, nothing is added
        q = E.timed(stream).writeStream.foreachBatch(E.into_table(f"{tmp_path}/t", ["event_id"])).option("checkpointLocation", f"{tmp_path}/c{turn}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 12


def test_incremental_and_deadlines(stream, spark, tmp_path):
    assert len(drain(E.incremental(stream, "event_id"), tmp_path)) == 12
    jobs = spark.createDataFrame([("a", dt.datetime(2024, 1, 2)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 3, 1))], "job string, due timestamp")
    assert [(r.job, r.due.day) for r in E.deadlines(jobs, "2024-02-01").collect()] == [("a", 1)]


def test_similar_drops_what_cannot_be_among_the_first(spark):
    """Before, all pairs were dealt by pair to add their weights; now they are scored where they are made."""
    import random

    from tests.test_social import nodes

    rng = random.Random(3)
    rows = [(d, "w", f"t{d % 3}") for d in range(60)] + [(d, "w", "all") for d in range(40)] + [(d, "v", f"c{rng.randrange(4)}") for d in range(60)] + [(1, "unknown", "z"), (2, "unknown", "z")]
    df = R.similar(spark.createDataFrame(rows, "d int, kind string, t string"), "d", "kind", "t", {"w": 3.0, "v": 1.0}, 60, 3, 0.5)
    got = {(r.doc, r.other, r.score, r.rank) for r in df.collect()}
    import math
    bag = {d: {(k, t) for x, k, t in rows if x == d and k != "unknown"} for d in range(60)}
    count = {}
    for keys in bag.values():
        for key in keys:
            count[key] = count.get(key, 0) + 1
    w = {key: {"w": 3.0, "v": 1.0}[key[0]] * math.log(1 + 60 / c) for key, c in count.items()}
    want = set()
    for d in bag:
        scored = sorted((-round(sum(w[x] for x in bag[d] & bag[o]), 6), o) for o in bag if o != d and any(count[x] <= 30 for x in bag[d] & bag[o]))
        want |= {(d, o, -s, j + 1) for j, (s, o) in enumerate(scored[:3]) if -s >= 0.5}
    assert got == want
    dealt = [p.outputPartitioning().toString() for p in nodes(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert dealt and not [x for x in dealt if "doc" in x and "other" in x]


def test_similar_deals_postings_three_times(spark):
    """Before, postings were dealt five times and met with bags of strings; a null document was one of n."""
    import math
    import random

    from tests.test_social import nodes

    rng = random.Random(9)
    rows = [(d, rng.choice("wv"), f"term {rng.randrange(40)}") for d in range(120) for _ in range(6)] + [(None, "w", "term 1"), (None, "w", "alone"), (3, "w", None), (4, "w", None), (5, None, "term 2"), (6, None, "term 2")]
    count = {key: len({d for d, *x in rows if tuple(x) == key}) for key in {(k, t) for _, k, t in rows if k and t}}
    bag = {d: {(k, t) for x, k, t in rows if x == d and count.get((k, t), 0) > 1} for d in range(120)}
    for v in (1.0, -0.5):
        df = R.similar(spark.createDataFrame(rows * 2, "d int, kind string, t string"), "d", "kind", "t", {"w": 3.0, "v": v}, 20, 4, 1.0)
        got = {(r.doc, r.other, r.score, r.rank) for r in df.collect()}
        w = {key: {"w": 3.0, "v": v}[key[0]] * math.log(1 + 120 / c) for key, c in count.items()}
        want = set()
        for d in bag:
            scored = sorted((-round(sum(w[x] for x in bag[d] & bag[o]), 6), o) for o in bag if o != d and any(count[x] <= 20 for x in bag[d] & bag[o]))
            want |= {(d, o, -s, j + 1) for j, (s, o) in enumerate(scored[:4]) if -s >= 1.0}
        assert want and got == want
    dealt = {p.canonicalized().toString(): p for p in nodes(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "ShuffleExchangeExec"}
    kinds = [p.schema().simpleString() for p in dealt.values()]
    assert not [x for x in kinds if "array<string>" in x] and sum("string" in x for x in kinds) == 1
