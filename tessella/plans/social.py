"""Follows, inboxes and entities with fallback keys, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import follows as W
from ..sources.tables import written
from .catalogue import Tables, query

MOST, EACH = 20, 5

_FOLLOWS = """l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT o_custkey AS user, CASE l_linenumber % 4 WHEN 1 THEN 'owner' WHEN 2 THEN 'thread' ELSE 'repo' END AS kind, CASE l_linenumber % 4 WHEN 1 THEN l_suppkey::VARCHAR WHEN 2 THEN l_partkey || '#' || l_orderkey % 4 ELSE l_partkey::VARCHAR END AS target,
CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'ignore' WHEN l_returnflag = 'A' THEN 'participating' ELSE 'all' END AS level, l_shipdate AS "at" FROM l),
o AS (SELECT DISTINCT l_suppkey::VARCHAR AS owner, l_partkey::VARCHAR AS subject FROM l),
x AS (SELECT "user", target AS subject, level, 'subscribed' AS reason, "at" FROM f WHERE level <> 'ignore' AND kind = 'repo' UNION ALL SELECT "user", split_part(target, '#', 1), 'participating', 'participating', "at" FROM f WHERE level <> 'ignore' AND kind = 'thread'
UNION ALL SELECT "user", subject, 'all', 'organization', "at" FROM f JOIN o ON owner = target WHERE level <> 'ignore' AND kind = 'owner'),
b AS (SELECT *, row_number() OVER (PARTITION BY "user", subject ORDER BY CASE level WHEN 'all' THEN 3 ELSE 1 END DESC, "at" DESC, reason DESC) AS j FROM x),
c AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY "at" DESC, subject) AS k, count(*) OVER (PARTITION BY "user") > 20 AS partial FROM b WHERE j = 1),
s AS (SELECT "user", subject, level, reason, "at", partial FROM c WHERE k <= 20)"""


def _follows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    level = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 3 == 0), 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).cast("tinyint")
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", level.alias("level")).join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))  # noqa: E741
    l = written(l.drop("o_orderkey"))  # noqa: E741  all three are made of it: the join is made once
    part, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 4
    follows = l.select(
        F.col("o_custkey").alias("user"),
        F.when(kind == 1, "owner").when(kind == 2, "thread").otherwise("repo").alias("kind"),
        F.when(kind == 1, F.col("l_suppkey").cast("string")).when(kind == 2, F.concat(part, F.lit("#"), (F.col("l_orderkey") % 4).cast("string"))).otherwise(part).alias("target"),
        F.when(F.col("level") == 0, "ignore").when(F.col("level") == 1, "participating").otherwise("all").alias("level"),
        F.col("l_shipdate").alias("at"),
    )
    owned = l.select(F.col("l_suppkey").cast("string").alias("owner"), part.alias("subject"))
    events = l.select(part.alias("subject"), (F.col("l_orderkey") % 4).cast("string").alias("thread"), F.col("o_custkey").alias("actor"), (F.col("l_suppkey") % 100).cast("long").alias("author"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return follows, owned, events


@query(f'WITH {_FOLLOWS} SELECT "user", subject, level, reason, "at", partial FROM s')
def follow_sources(t: Tables) -> DataFrame:
    follows, owned, _ = _follows(t)
    return W.sources(follows, owned, MOST)


@query(f"""WITH {_FOLLOWS}, e AS (SELECT l_partkey::VARCHAR AS subject, (l_orderkey % 4)::VARCHAR AS thread, o_custkey AS actor, l_suppkey % 100 AS author, l_shipdate AS "at", row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS k FROM l WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00'),
h AS (SELECT "user", target, level AS followed FROM (SELECT *, row_number() OVER (PARTITION BY "user", target ORDER BY "at" DESC, level DESC) AS k FROM f WHERE kind = 'thread') WHERE k = 1),
m AS (SELECT s."user", s.subject, e.thread, e."at", s.partial, CASE WHEN e.author = s."user" THEN 'author' WHEN followed = 'all' THEN 'participating' WHEN s.level = 'all' THEN s.reason END AS reason
FROM s JOIN e ON e.subject = s.subject AND e.k <= 5 AND e.actor <> s."user" LEFT JOIN h ON h."user" = s."user" AND h.target = s.subject || '#' || e.thread WHERE followed IS NULL OR followed <> 'ignore')
SELECT "user", subject, thread, count(*) AS n, max("at") AS latest, arg_max(reason, CASE reason WHEN 'author' THEN 5 WHEN 'participating' THEN 4 WHEN 'subscribed' THEN 3 ELSE 2 END) AS reason, bool_or(partial) AS partial FROM m WHERE reason IS NOT NULL GROUP BY 1, 2, 3""")
def follow_inbox(t: Tables) -> DataFrame:
    follows, owned, events = _follows(t)
    return W.inbox(W.sources(follows, owned, MOST), events, follows, F.lit("1994-01-01").cast("timestamp_ntz"), EACH)


@query("""WITH e AS (SELECT s_suppkey, n_name || ' Letters ' || s_suppkey % 4 AS title FROM supplier JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, min(s_suppkey) AS one FROM e GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS own, CASE l_linenumber % 5 WHEN 1 THEN upper(title) WHEN 2 THEN '  ' || title || '. ' WHEN 3 THEN title || ' (Online)' WHEN 4 THEN ' -- ' ELSE title END AS title FROM lineitem JOIN e ON s_suppkey = l_suppkey),
k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN own IS NOT NULL THEN own::VARCHAR WHEN one IS NOT NULL THEN one::VARCHAR WHEN k.t <> '' THEN 'title:' || k.t END AS resolved, CASE WHEN own IS NOT NULL THEN 'key' WHEN one IS NOT NULL THEN 'title' WHEN k.t <> '' THEN 'made' END AS "by" FROM k LEFT JOIN u ON u.t = k.t""")
def fallback_keys(t: Tables) -> DataFrame:
    """Each line's journal: its own key, else the one journal of that title, else a made key."""
    title = F.concat("n_name", F.lit(" Letters "), (F.col("s_suppkey") % 4).cast("string"))
    journals = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", title.alias("title"))
    shape = F.col("l_linenumber") % 5
    said = F.when(shape == 1, F.upper("title")).when(shape == 2, F.concat(F.lit("  "), "title", F.lit(". "))).when(shape == 3, F.concat("title", F.lit(" (Online)"))).when(shape == 4, " -- ").otherwise(F.col("title"))
    rows = t.lineitem.join(journals, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey")).alias("own"), said.alias("said"))
    return W.with_fallback(rows, journals, "own", "said", "s_suppkey", "title").select("l_orderkey", "l_linenumber", "resolved", "by")
