"""Further registered queries: entities, judgement, incremental layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import entities as N
from ..operators import greedy as G
from ..operators import relational as R
from .catalogue import Tables, query


@query("""WITH a AS (SELECT c_nationkey AS g, c_custkey AS id, lower(c_mktsegment) AS name, CAST(floor(c_acctbal / 500) AS BIGINT) AS pos FROM customer WHERE c_acctbal >= 4500), b AS (SELECT c_nationkey AS g, c_custkey AS id, lower(c_mktsegment) AS name, CAST(floor((c_acctbal + 5500) / 500) AS BIGINT) AS pos FROM customer WHERE c_acctbal < 4500),
p AS (SELECT x.g, x.id AS "left", y.id AS "right" FROM (SELECT g, pos, name, min(id) AS id FROM a GROUP BY 1, 2, 3 HAVING count(*) = 1) x JOIN (SELECT g, pos, name, min(id) AS id FROM b GROUP BY 1, 2, 3 HAVING count(*) = 1) y ON x.g = y.g AND x.pos = y.pos AND x.name = y.name),
a2 AS (SELECT * FROM a WHERE id NOT IN (SELECT "left" FROM p)), b2 AS (SELECT * FROM b WHERE id NOT IN (SELECT "right" FROM p)),
q AS (SELECT x.g, x.id AS "left", y.id AS "right" FROM (SELECT g, name, min(id) AS id FROM a2 GROUP BY 1, 2 HAVING count(*) = 1) x JOIN (SELECT g, name, min(id) AS id FROM b2 GROUP BY 1, 2 HAVING count(*) = 1) y ON x.g = y.g AND x.name = y.name)
SELECT g, "left", "right", 'position' AS how FROM p UNION ALL SELECT g, "left", "right", 'name' FROM q""")
def person_pairing(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")

    def side(rows: DataFrame, at: Column) -> DataFrame:
        return rows.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.lit("").alias("orcid"), F.floor(at / 500).alias("position"), F.col("c_mktsegment").alias("name"))

    return N.pair_people(side(t.customer.filter(b >= 4500), b), side(t.customer.filter(b < 4500), b + 5500), "g")


@query("""WITH x AS (SELECT DISTINCT t, list_distinct(string_split(t, ' ')) AS k FROM (SELECT p_name || ' ' || p_brand || ' ' || p_type AS t FROM part)), y AS (SELECT a.t AS a, b.t AS b, round(len(list_intersect(a.k, b.k)) / len(a.k), 6) AS share FROM x a JOIN x b ON len(a.k) < len(b.k) OR (len(a.k) = len(b.k) AND a.t < b.t))
SELECT a, b, share FROM y WHERE share >= 0.7""")
def title_containment(t: Tables) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t")
    return R.contained(t.part.select(title).distinct().withColumn("k", F.split("t", " ")), "t", "k", 0.7)


@query("""SELECT n_name, max(CASE WHEN s_acctbal > 9000 THEN 3 WHEN s_acctbal > 5000 THEN 2 ELSE 1 END) AS level, count(*) AS n, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def layer_join(t: Tables) -> DataFrame:
    level = F.when(F.col("s_acctbal") > 9000, 3).when(F.col("s_acctbal") > 5000, 2).otherwise(1)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), ",")
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.max(level).alias("level"), F.count("*").alias("n"), names.alias("names"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'human' WHEN o_orderpriority = '5-LOW' THEN 'dismissed' ELSE 'open' END AS triage FROM orders""")
def triage_overlay(t: Tables) -> DataFrame:
    human = t.orders.filter("o_totalprice > 400000").select("o_orderkey", F.lit("human").alias("told"))
    auto = F.when(F.col("o_orderpriority") == "5-LOW", "dismissed").otherwise("open")
    return t.orders.join(human, "o_orderkey", "left").select("o_orderkey", F.coalesce("told", auto).alias("triage"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), k AS (SELECT * FROM r WHERE rank <= 40) SELECT k.rank, c.c_custkey, c_name FROM k JOIN customer c ON c.c_custkey = k.c_custkey WHERE c.c_nationkey <> 3""")
def fetch_in_rank_order(t: Tables) -> DataFrame:
    top = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))
    return top.join(t.customer.filter("c_nationkey <> 3"), "c_custkey").select("rank", "c_custkey", "c_name").orderBy("rank")


@query("""WITH e AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS r FROM events) SELECT user_id, count(*) AS n, CASE max(r) WHEN 3 THEN 'purchase' WHEN 2 THEN 'signup' WHEN 1 THEN 'click' ELSE 'other' END AS reason FROM e GROUP BY user_id""")
def strongest_reason(t: Tables) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    out = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max(rank).alias("r"))
    return out.select("user_id", "n", F.element_at(F.array(*map(F.lit, ("other", "click", "signup", "purchase"))), F.col("r") + 1).alias("reason"))


@query("""WITH c AS (SELECT l_suppkey AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(v), v) AS i FROM c) SELECT k, v, n FROM r WHERE i = 1""")
def most_common_value(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v")).agg(F.count("*").alias("n"))
    return R.ranked(c, ["k"], [F.desc("n"), F.length("v"), "v"], 1).drop("rank")


@query("""WITH m AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r FROM orders), b AS (SELECT *, min(r) OVER (PARTITION BY o_custkey) AS best FROM m) SELECT o_custkey, o_orderkey FROM b WHERE r = best""")
def label_precedence(t: Tables) -> DataFrame:
    return N.precedence(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", ["P", "O", "F"], F.lit(True)).select("o_custkey", "o_orderkey")


@query("""WITH d AS (SELECT DISTINCT l_partkey AS part, o_custkey AS cust FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT part, count(*) AS n FROM d GROUP BY 1), r AS (SELECT part, cust, row_number() OVER (PARTITION BY part ORDER BY cust) AS k FROM d)
SELECT r.part, n.n, r.cust, r.k AS rank FROM r JOIN n ON r.part = n.part WHERE r.k <= 5""")
def bounded_sample(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("part"), F.col("o_custkey").alias("cust")).distinct()
    return R.ranked(d, ["part"], ["cust"], 5).join(d.groupBy("part").agg(F.count("*").alias("n")), "part").select("part", "n", "cust", "rank")


@query("""SELECT CASE p_type WHEN 'PROMO' THEN 'ECONOMY' WHEN 'STANDARD' THEN 'MEDIUM' ELSE p_type END AS topic, count(*) AS n FROM part GROUP BY 1""")
def aliased_topics(t: Tables) -> DataFrame:
    alias = F.create_map(*map(F.lit, ("PROMO", "ECONOMY", "STANDARD", "MEDIUM")))
    return t.part.groupBy(F.coalesce(alias[F.col("p_type")], F.col("p_type")).alias("topic")).agg(F.count("*").alias("n"))


@query("""SELECT source, bool_or(contains(text, 'license') OR contains(text, 'License')) AS has_license, sum(CASE WHEN contains(text, '|') THEN 1 ELSE 0 END)::BIGINT AS tables, round(avg(CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END), 3) AS shouting FROM documents GROUP BY source""")
def repository_features(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.groupBy("source").agg(F.bool_or(x.contains("license") | x.contains("License")).alias("has_license"), F.count_if(x.contains("|")).alias("tables"), F.round(F.avg(x.contains("!!").cast("int")), 3).alias("shouting"))


@query("""WITH d AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'changes' WHEN 2 THEN 'comment' ELSE 'dismissed' END AS state FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS i FROM d WHERE state <> 'comment' AND role <> 'system')
SELECT conv_id, sum(CASE WHEN state = 'approved' THEN 1 ELSE 0 END)::BIGINT AS approved, sum(CASE WHEN state = 'changes' THEN 1 ELSE 0 END)::BIGINT AS changes FROM k WHERE i = 1 GROUP BY conv_id""")
def decisive_reviews(t: Tables) -> DataFrame:
    k = F.col("turn") % 4
    state = F.when(k == 0, "approved").when(k == 1, "changes").when(k == 2, "comment").otherwise("dismissed")
    return N.decisive_reviews(t.conversations.select("conv_id", "turn", "role", state.alias("state"), F.lit("system").alias("author")), "conv_id", "role", "state", "turn", "author")


@query("""WITH e AS (SELECT user_id, event_type, max(ts) AS latest, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, max(ts) AS read_at FROM events WHERE event_type = 'view' GROUP BY 1) SELECT e.user_id, e.event_type, latest, n, coalesce(latest > read_at, true) AS unread FROM e LEFT JOIN s ON e.user_id = s.user_id""")
def inbox_threads(t: Tables) -> DataFrame:
    state = t.events.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("read_at"))
    e = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("latest"), F.count("*").alias("n"))
    return e.join(state, "user_id", "left").select("user_id", "event_type", "latest", "n", F.coalesce(F.col("latest") > F.col("read_at"), F.lit(True)).alias("unread"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE nullif(c_mktsegment, 'BUILDING') END, c_name) AS value, CASE WHEN c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING' THEN 'segment' ELSE 'name' END AS source FROM customer""")
def first_filled(t: Tables) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", N.first_filled([("segment", segment), ("name", F.col("c_name"))]).alias("f")).select("c_custkey", "f.value", "f.source")


@query("""WITH c AS (SELECT o_orderkey AS k, 'a' AS role, CASE o_orderstatus WHEN 'F' THEN 1.5 ELSE 0.25 END AS w FROM orders UNION ALL SELECT o_orderkey, 'b', CASE o_orderpriority WHEN '1-URGENT' THEN 2.0 WHEN '5-LOW' THEN -1.0 ELSE 0.5 END FROM orders UNION ALL SELECT o_orderkey, 'a', CASE WHEN o_totalprice > 250000 THEN 0.5 ELSE -0.25 END FROM orders),
s AS (SELECT k, role, round(sum(w), 6) AS s FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, role) AS i, lead(s) OVER (PARTITION BY k ORDER BY s DESC, role) AS nxt FROM s)
SELECT k, CASE WHEN s >= 1.5 THEN role ELSE 'unknown' END AS verdict, CAST(s AS DOUBLE) AS score, CAST(round(s - coalesce(nxt, 0), 6) AS DOUBLE) AS margin FROM r WHERE i = 1""")
def link_roles(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").alias("k")
    clues = [("a", F.when(F.col("o_orderstatus") == "F", 1.5).otherwise(0.25)), ("b", F.when(F.col("o_orderpriority") == "1-URGENT", 2.0).when(F.col("o_orderpriority") == "5-LOW", -1.0).otherwise(0.5)), ("a", F.when(F.col("o_totalprice") > 250000, 0.5).otherwise(-0.25))]
    told = t.orders.select(k, F.explode(F.array(*[F.struct(F.lit(r).alias("role"), w.alias("w")) for r, w in clues])).alias("c")).select("k", "c.*")
    return N.evidence(told, ["k"], "role", "w", 1.5)


@query("""WITH s AS (SELECT doc_id, least(len(regexp_extract_all(text, 'the')), 5) * 0.5 + least(len(regexp_extract_all(text, 'tion')), 5) * 1.0 AS en, least(len(regexp_extract_all(text, 'ung')), 5) * 1.0 AS de FROM documents)
SELECT doc_id, 'en' AS value, round(1 - exp(-en / 2.5), 6) AS confidence FROM s WHERE en > 0 UNION ALL SELECT doc_id, 'de', round(1 - exp(-de / 2.5), 6) FROM s WHERE de > 0""")
def rule_classifier(t: Tables) -> DataFrame:
    return N.rule_scores(t.documents, "doc_id", F.col("text"), [("en", "the", 0.5), ("en", "tion", 1.0), ("de", "ung", 1.0)], 5)


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'code_verified' WHEN bool_or(o_orderstatus = 'O' AND o_totalprice > 300000) THEN 'code_found' WHEN bool_or(o_orderpriority = '5-LOW') THEN 'on_request' ELSE 'no_code' END AS status FROM orders GROUP BY o_custkey""")
def paper_status(t: Tables) -> DataFrame:
    hit = lambda c: F.bool_or(c)
    status = F.when(hit(F.col("o_orderstatus") == "P"), "code_verified").when(hit((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000)), "code_found").when(hit(F.col("o_orderpriority") == "5-LOW"), "on_request").otherwise("no_code")
    return t.orders.groupBy("o_custkey").agg(status.alias("status"))


@query("""SELECT p_partkey, strftime(m, '%Y-%m') AS month FROM (SELECT p_partkey, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-01' + to_months(CAST(p_size % 6 AS INTEGER)), INTERVAL 1 MONTH)) AS m FROM part)""")
def month_walk(t: Tables) -> DataFrame:
    first = F.lit("2024-01-01").cast("date")
    months = F.explode(F.sequence(F.add_months(first, F.col("p_size") % 6), first, F.expr("interval -1 month"))).alias("m")
    return t.part.select("p_partkey", months).select("p_partkey", F.date_format("m", "yyyy-MM").alias("month"))


@query("""WITH a AS (SELECT user_id, CAST(floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') / 604800.0) AS BIGINT) AS week FROM events) SELECT user_id, week, count(*) AS n FROM a WHERE week < 4 GROUP BY 1, 2""")
def participation_weeks(t: Tables) -> DataFrame:
    back = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.groupBy("user_id", F.floor(back / 604800).alias("week")).agg(F.count("*").alias("n")).filter("week < 4")


@query("""SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'P' AND o_totalprice > 100000) DESC, 3 * CASE WHEN contains(o_orderpriority, 'H') THEN 1 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END DESC, o_orderkey LIMIT 100""")
def pinned_first(t: Tables) -> DataFrame:
    pinned = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)
    score = 3 * F.col("o_orderpriority").contains("H").cast("int") + (F.col("o_totalprice") > 200000).cast("int")
    return t.orders.orderBy(F.desc(pinned), F.desc(score), "o_orderkey").limit(100).select("o_orderkey")


@query("""SELECT r_name, n_name, sum(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN s_acctbal <= 5000 AND s_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS low FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_nationkey <> 4 GROUP BY 1, 2""")
def severity_overview(t: Tables) -> DataFrame:
    dismissed = t.supplier.filter("s_nationkey = 4").select("s_suppkey")
    j = t.supplier.join(dismissed, "s_suppkey", "left_anti").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count_if(F.col("s_acctbal") > 5000).alias("high"), F.count_if((F.col("s_acctbal") <= 5000) & (F.col("s_acctbal") > 0)).alias("low"))


@query()
def random_caps(t: Tables) -> DataFrame:
    return G.capped(t.documents.select("doc_id", "source", "lang"), 7, ["doc_id"], {"source": 3})


@query()
def diversified_choice(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_suppkey").alias("paper"), F.col("l_partkey").alias("paragraph"), F.col("l_orderkey").alias("unit"), (F.col("l_orderkey") % 50).alias("file"), F.col("l_extendedprice").alias("score"))
    return G.diversified(c, "paper", "score", {"paragraph": 2, "unit": 2}, ("file", "unit"))


@query("""WITH v AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 12 AS b, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 11 END AS rc FROM part) SELECT p_partkey, a || '.' || b || '.0' || coalesce('-rc.' || rc, '') AS version, dense_rank() OVER (ORDER BY a, b, rc IS NULL, rc) AS place FROM v""")
def semver_order(t: Tables) -> DataFrame:
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 12).cast("string"), F.lit("0"))
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(v, F.lit("-rc."), (F.col("p_partkey") % 11).cast("string"))).otherwise(v)
    rows = t.part.select("p_partkey", v.alias("version"))
    # distinct versions are few beside the rows, so only they are put in order
    order = rows.select("version").distinct().withColumn("place", F.row_number().over(Window.orderBy(S.semver_key(F.col("version")))))
    return rows.join(order, "version").select("p_partkey", "version", "place")
