"""Follows, inboxes, fallback keys and deletion budgets against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tessella.operators import delta as D
from tessella.operators import follows as W

DAY = datetime(2024, 1, 1)
RANK = {"all": 3, "custom": 2, "participating": 1}


def plain_sources(follows, owned, most):
    found = {}
    for user, kind, target, level, at in follows:
        if level == "ignore":
            continue
        got = {"repo": [(target, level, "subscribed")], "thread": [(target.rpartition("#")[0], "participating", "participating")], "owner": [(s, "all", "organization") for o, s in owned if o == target]}[kind]
        for subject, lv, reason in got:
            found.setdefault(user, {}).setdefault(subject, []).append((RANK[lv], at, reason, lv))
    out = set()
    for user, subjects in found.items():
        best = sorted(((s, max(v)) for s, v in subjects.items()), key=lambda x: (-x[1][1].timestamp(), x[0]))
        out |= {(user, s, lv, reason, at, len(best) > most) for s, (_, at, reason, lv) in best[:most]}
    return out


def table(seed=2):
    """One owner has a third of all subjects and is followed by a third of all users."""
    rng = random.Random(seed)
    owned = [("big", f"s{k:03d}") for k in range(60)] + [(f"o{rng.randrange(9)}", f"s{rng.randrange(180):03d}") for _ in range(160)]
    follows = []
    for u in range(60):
        for _ in range(rng.randint(1, 9)):
            kind = rng.choice(["repo", "owner", "thread"])
            subject = f"s{rng.randrange(180):03d}"
            target = {"repo": subject, "owner": f"o{rng.randrange(9)}", "thread": f"{subject}#{rng.randrange(3)}"}[kind]
            follows.append((u, kind, target, rng.choice(["all", "all", "participating", "ignore"]), DAY + timedelta(hours=rng.randrange(40))))
        if u % 3 == 0:
            follows.append((u, "owner", "big", "all", DAY + timedelta(hours=20)))
    return follows, owned


def test_sources(spark):
    follows, owned = table()
    f = spark.createDataFrame(follows, "user int, kind string, target string, level string, at timestamp")
    o = spark.createDataFrame(owned, "owner string, subject string")
    for most in (3, 10, 1000):
        got = {tuple(r) for r in W.sources(f, o, most).select("user", "subject", "level", "reason", "at", "partial").collect()}
        assert got == plain_sources(follows, owned, most)
    assert W.sources(f.limit(0), o, 5).count() == 0


def test_inbox(spark):
    at = [DAY + timedelta(hours=k) for k in range(10)]
    follows = spark.createDataFrame([(1, "repo", "a", "all", at[1]), (1, "thread", "a#2", "ignore", at[2]), (2, "repo", "a", "participating", at[1]), (2, "thread", "b#1", "all", at[3])], "user int, kind string, target string, level string, at timestamp")
    events = [("a", "1", 9, 2, at[5], 1), ("a", "1", 1, 9, at[6], 2), ("a", "2", 9, 9, at[6], 3), ("b", "1", 9, 9, at[4], 4), ("b", "2", 9, 9, at[4], 5), ("a", "3", 9, 9, at[7], 6), ("a", "9", 9, 9, at[0], 7)]
    e = spark.createDataFrame(events, "subject string, thread string, actor int, author int, at timestamp, id int")
    found = W.sources(follows, spark.createDataFrame([], "owner string, subject string"), 5)
    got = {(r.user, r.subject, r.thread, r.n, r.reason) for r in W.inbox(found, e, follows, F.lit(at[1]), 50).collect()}
    assert got == {(1, "a", "1", 1, "subscribed"), (1, "a", "3", 1, "subscribed"), (2, "a", "1", 1, "author"), (2, "b", "1", 1, "participating")}
    newest = {(r.user, r.subject, r.thread, r.n) for r in W.inbox(found, e, follows, F.lit(at[1]), 1).collect()}
    assert newest == {(1, "a", "3", 1)}


def test_keys_fall_back_in_order(spark):
    rows = [(1, "j9", "Any"), (2, None, "The  Journal!"), (3, "", "twice"), (4, None, "Unknown, one"), (5, None, None), (6, None, " -- "), (7, None, "THE JOURNAL")]
    known = [("j1", "The Journal"), ("j2", "Twice"), ("j3", "twice."), ("j1", "the journal")]
    got = W.with_fallback(spark.createDataFrame(rows, "id int, k string, t string"), spark.createDataFrame(known, "j string, name string"), "k", "t", "j", "name").collect()
    assert {r.id: (r.resolved, r.by) for r in got} == {1: ("j9", "key"), 2: ("j1", "title"), 3: ("title:twice", "made"), 4: ("title:unknown one", "made"), 5: (None, None), 6: (None, None), 7: ("j1", "title")}


def test_what_a_rule_leaves_goes_to_the_next(spark):
    rows = [(k, 1) for k in range(10)] + [(100 + k, 2) for k in range(4)] + [(200, 3)]
    df = spark.createDataFrame(rows, "id int, kind int").repartition(3)
    take = lambda room, cost: sorted(r.id for r in D.deletable(df, F.col("kind") < 3, F.col("kind"), ["id"], cost, room).collect())
    assert take(5, {1: 2, 2: 1}) == [0, 1, 100]
    assert take(100, {1: 2, 2: 1}) == [*range(10), 100, 101, 102, 103]
    assert take(1, {1: 2, 2: 1}) == [100] and take(0, {1: 2, 2: 1}) == []


def nodes(plan):
    """All operators of a plan that has run, also those within adaptive stages."""
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return [plan, *[x for p in below for x in nodes(p)]]


def test_old_owners_are_not_fanned_out(spark):
    """Each user follows 20 owners of 30 subjects: before, each gave its first subjects, 8 x 20 x 4 rows."""
    owned = [(f"o{k}", f"s{k:02d}-{j:02d}") for k in range(20) for j in range(30)]
    follows = [(u, "owner", f"o{k}", "all", DAY + timedelta(hours=k)) for u in range(8) for k in range(20)] + [(u, "thread", f"s{k:02d}-29#1", "all", DAY + timedelta(hours=19 + k)) for u in range(8) for k in range(20)]
    df = W.sources(spark.createDataFrame(follows, "user int, kind string, target string, level string, at timestamp"), spark.createDataFrame(owned, "owner string, subject string"), 3)
    got = {tuple(r) for r in df.select("user", "subject", "level", "reason", "at", "partial").collect()}
    assert got == plain_sources(follows, owned, 3)
    joins = [p.metrics().apply("numOutputRows").value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.getClass().getSimpleName()]
    assert joins and max(joins) <= 8 * 20


def test_sources_of_many_shapes(spark):
    for seed in (5, 6, 7):
        follows, owned = table(seed)
        rng = random.Random(seed)
        follows = [(u, k, t, rng.choice(["custom", "participating", "all"]) if lv == "all" else lv, a) for u, k, t, lv, a in follows]
        f = spark.createDataFrame(follows, "user int, kind string, target string, level string, at timestamp")
        got = {tuple(r) for r in W.sources(f, spark.createDataFrame(owned, "owner string, subject string"), 4).select("user", "subject", "level", "reason", "at", "partial").collect()}
        assert got == plain_sources(follows, owned, 4)


def test_follows_are_dealt_once(spark):
    """Before, lines met orders in each of seven reads, and follows were dealt again for each aggregation."""
    from tessella.plans import social
    from tessella.plans.catalogue import Tables

    follows, owned = table(8)
    follows += [(None, "repo", "s001", "all", DAY), (None, "thread", "s002#1", "all", DAY)]
    f = spark.createDataFrame(follows, "user int, kind string, target string, level string, at timestamp")
    df = W.sources(f, spark.createDataFrame([*owned, (None, "s001")], "owner string, subject string"), 4)
    got = {tuple(r) for r in df.select("user", "subject", "level", "reason", "at", "partial").collect()}
    assert got == plain_sources(follows, owned, 4)
    dealt = [p.outputPartitioning().toString() for p in nodes(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert dealt and not [x for x in dealt if "user" in x and "subject" in x]
    for x in social._follows(Tables(spark, "/root/testdata/sf0.001")):
        assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_inbox_against_sql_shapes(spark):
    """A thread followed at "all" counts all its events, one that is not only those that its source brings."""
    at = [DAY + timedelta(hours=k) for k in range(9)]
    found = spark.createDataFrame([(1, "a", "participating", "subscribed", at[0], True), (1, "b", "all", "organization", at[0], False), (2, "a", "all", "participating", at[0], False)], "user int, subject string, level string, reason string, at timestamp, partial boolean")
    follows = spark.createDataFrame([(1, "thread", "a#1", "all", at[0]), (2, "thread", "a#2", "ignore", at[0]), (None, "thread", "a#1", "all", at[0])], "user int, kind string, target string, level string, at timestamp")
    e = spark.createDataFrame([("a", "1", 9, 8, at[1], 1), ("a", "1", 9, 1, at[2], 2), ("a", "2", 9, 8, at[3], 3), ("a", "3", 9, 1, at[4], 4), ("a", "3", 9, 8, at[5], 5), ("b", "1", 9, 8, at[6], 6), ("b", "1", 1, 8, at[7], 7)], "subject string, thread string, actor int, author int, at timestamp, id int")
    got = {tuple(r) for r in W.inbox(found, e, follows, F.lit(DAY), 9).select("user", "subject", "thread", "n", "latest", "reason", "partial").collect()}
    assert got == {(1, "a", "1", 2, at[2], "author", True), (1, "a", "3", 1, at[4], "author", True), (1, "b", "1", 1, at[6], "organization", False), (2, "a", "1", 2, at[2], "participating", False), (2, "a", "3", 2, at[5], "participating", False)}
