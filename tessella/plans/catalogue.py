"""The registered queries, each with the SQL that says the same on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import delta as D
from ..operators import relational as R
from ..operators import search as Q
from ..operators import series as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(c: str) -> Column:
    """Exact sums: two decimals, whatever the order of rows."""
    return F.col(c).cast("decimal(18,2)")


def in_scope() -> Column:
    return F.col("n_chars").isNotNull() & (F.col("source") != "src19") & (F.col("text") != "")


# -- predicates and projections


@query("""WITH s AS (SELECT lang, source FROM documents WHERE n_chars IS NOT NULL AND source <> 'src19' AND text <> ''),
c AS (SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM s WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM s WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM c)
SELECT facet, value, n, rank FROM r WHERE rank <= 10""")
def facet_counts(t: Tables) -> DataFrame:
    return R.facet_counts(t.documents.filter(in_scope()), ["lang", "source"], 10)


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE n_chars IS NOT NULL AND source <> 'src19' AND text <> '' AND lang IN ('en', 'fr')")
def scope_counts(t: Tables) -> DataFrame:
    return t.documents.filter(in_scope() & F.col("lang").isin("en", "fr")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a1%' OR lower(p_brand) LIKE '%#3%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
def substring_or_exists(t: Tables) -> DataFrame:
    hit = t.lineitem.filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return t.part.join(hit, "p_partkey", "left").filter(F.col("p_name").ilike("%a1%") | F.col("p_brand").ilike("%#3%") | F.col("hit")).select("p_partkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^[12][0-9]{3}') AND NOT coalesce(o_totalprice > 200000, false) GROUP BY o_orderstatus")
def class_filter_and_keep(t: Tables) -> DataFrame:
    dated = F.date_format("o_orderdate", "yyyy-MM-dd").rlike("^[12][0-9]{3}")
    return t.orders.filter(dated & ~F.coalesce(F.col("o_totalprice") > 200000, F.lit(False))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE source LIKE 'src_' GROUP BY source")
def like_wildcard(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("source").like("src_")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k is not null")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'withheld' ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS nation FROM customer")
def case_masking(t: Tables) -> DataFrame:
    low = F.col("c_acctbal") < 0
    return t.customer.select("c_custkey", F.when(low, "withheld").otherwise(F.col("c_name")).alias("name"), F.when(~low, F.col("c_nationkey")).alias("nation"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND user_id >= 20 AND user_id <= 60 AND value > 10")
def optional_filters(t: Tables) -> DataFrame:
    asked = {"event_type": F.col("event_type") == "error", "user": F.col("user_id").between(20, 60), "least": F.col("value") > 10}
    return t.events.filter(S.all_of(list(asked.values()))).select("event_id")


@query("SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) BETWEEN 5 AND 8 OR count(*) >= 20")
def count_conditions(t: Tables) -> DataFrame:
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))
    return n.filter(S.count_condition(F.col("n"), "5..8") | S.count_condition(F.col("n"), ">=20"))


@query("SELECT count(*) AS n FROM orders WHERE substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 10) >= '1995-03-01' AND substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 10) <= '1996-02-15'")
def date_conditions(t: Tables) -> DataFrame:
    return t.orders.filter(S.date_condition(F.date_format("o_orderdate", "yyyy-MM-dd"), "1995-03-01..1996-02-15")).agg(F.count("*").alias("n"))


@query("""SELECT family, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, 'agpl|affero') THEN 'network copyleft' WHEN regexp_matches(t, 'lgpl|mpl|lesser') THEN 'weak copyleft' WHEN regexp_matches(t, 'gpl|general public') THEN 'copyleft' WHEN regexp_matches(t, 'apache|mit|bsd') THEN 'permissive'
WHEN regexp_matches(t, 'cc by-nc') THEN 'non-commercial' WHEN regexp_matches(t, 'cc by') THEN 'attribution' ELSE 'unknown' END AS family FROM (SELECT lower(text) AS t FROM documents)) GROUP BY family""")
def license_families(t: Tables) -> DataFrame:
    return t.documents.groupBy(S.license_family(F.col("text")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal < 1000) AND event_type NOT IN ('error', 'signup')")
def hidden_by_blocks(t: Tables) -> DataFrame:
    blocked = t.customer.filter("c_acctbal < 1000").select(F.col("c_custkey").alias("user_id"))
    return t.events.filter(~F.col("event_type").isin("error", "signup")).join(blocked, "user_id", "left_anti").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE date_diff('day', ts, TIMESTAMP '2024-01-31 00:00:00') < CASE event_type WHEN 'error' THEN 7 WHEN 'view' THEN 14 ELSE 1000 END GROUP BY event_type")
def retention(t: Tables) -> DataFrame:
    return D.retained(t.events, "ts", F.lit("2024-01-31").cast("date"), {"error": 7, "view": 14}, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


# -- joins


@query("SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def inner_join_count(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def scalar_subquery_count(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 0)")
def semi_and_anti(t: Tables) -> DataFrame:
    far = t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    big = t.lineitem.filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.join(big, "s_suppkey", "left_semi").join(far, "s_nationkey", "left_anti").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphans(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)")
def two_key_semi(t: Tables) -> DataFrame:
    often = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")
    return t.lineitem.join(often, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT (SELECT count(*) FROM (SELECT 1 FROM orders LIMIT 1000)) + (SELECT count(*) FROM (SELECT 1 FROM part LIMIT 500)) AS n")
def capped_sources(t: Tables) -> DataFrame:
    return t.orders.limit(1000).select(F.lit(1).alias("x")).unionAll(t.part.limit(500).select(F.lit(1).alias("x"))).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS custkey, p_brand AS brand, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand""")
def used_by_distinct(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("custkey"), F.col("p_brand").alias("brand")).agg(F.countDistinct("l_partkey").alias("parts"))


@query("""WITH a AS (SELECT doc_id, lang AS v FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'xx' ELSE lang END AS v FROM documents WHERE source <> 'src2')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v IS DISTINCT FROM b.v""")
def tree_diff(t: Tables) -> DataFrame:
    # two snapshots of one table: a source comes, a source goes, long texts change
    old = t.documents.filter("source <> 'src1'").select("doc_id", "lang")
    new = t.documents.filter("source <> 'src2'").select("doc_id", F.when(F.col("n_chars") > 3000, "xx").otherwise(F.col("lang")).alias("lang"))
    return R.tree_diff(old, new, "doc_id", "lang")


@query("""SELECT o_orderkey, CASE WHEN o.v = o.b AND w.v = w.b THEN 'unchanged' WHEN o.v = w.v THEN 'both' WHEN w.v = w.b THEN 'ours' WHEN o.v = o.b THEN 'theirs' ELSE 'conflict' END AS outcome
FROM (SELECT o_orderkey, o_orderstatus AS b, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS v FROM orders) o
JOIN (SELECT o_orderkey, o_orderstatus AS b, CASE WHEN o_totalprice > 300000 THEN 'X' WHEN o_totalprice > 250000 THEN 'Y' WHEN o_orderpriority = '5-LOW' THEN 'Z' ELSE o_orderstatus END AS v FROM orders) w USING (o_orderkey)""")
def three_way_merge(t: Tables) -> DataFrame:
    k, s, price = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    base = t.orders.select(k, s.alias("v"))
    ours = t.orders.select(k, F.when(price > 200000, "X").otherwise(s).alias("v"))
    theirs = t.orders.select(k, F.when(price > 300000, "X").when(price > 250000, "Y").when(F.col("o_orderpriority") == "5-LOW", "Z").otherwise(s).alias("v"))
    return R.merge_three(base, ours, theirs, "o_orderkey", "v")


@query("""WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey <> 3) SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN 99 ELSE s_nationkey END AS s_nationkey FROM b WHERE s_acctbal >= 0
UNION ALL SELECT s_suppkey, 98 FROM supplier WHERE s_nationkey = 3""")
def edit_overlay(t: Tables) -> DataFrame:
    base = t.supplier.filter("s_nationkey <> 3").select("s_suppkey", "s_nationkey")
    op = F.when(F.col("s_nationkey") == 3, "add").when(F.col("s_acctbal") > 6000, "set").when(F.col("s_acctbal") < 0, "remove")
    edits = t.supplier.select("s_suppkey", op.alias("op"), F.when(op == "add", 98).otherwise(99).alias("s_nationkey")).filter("op is not null")
    return R.overlay(base, edits, ["s_suppkey"], "op", "s_nationkey")


@query("""WITH n AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS key, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_linenumber = 1),
o AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS key, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_linenumber = 2),
p AS (SELECT n.g, n.key, o.key AS match, least(n.e, o.e) - greatest(n.s, o.s) + 1 AS overlap FROM n JOIN o ON n.g = o.g AND n.s <= o.e AND o.s <= n.e),
r AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY overlap DESC, match) AS k FROM p) SELECT g, key, match, overlap FROM r WHERE k = 1""")
def best_overlap(t: Tables) -> DataFrame:
    at = (F.col("l_partkey") % 1000).alias("s")
    rows = t.lineitem.select("l_linenumber", F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), at, (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("long")).alias("e"))
    return R.best_overlap(rows.filter("l_linenumber = 1"), rows.filter("l_linenumber = 2"), ["g"], "s", "e", "key")


# -- aggregations


@query("""SELECT count(*) AS events, count(DISTINCT user_id) AS users, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0)::BIGINT AS errors, max(ts) AS latest,
sum(CAST(value AS DECIMAL(18,2))) AS total FROM events""")
def kpi_block(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("latest"), F.sum(money("value")).alias("total"))


@query("SELECT lang, round(100.0 * count(DISTINCT CASE WHEN quality IS NOT NULL THEN d.doc_id END) / count(DISTINCT d.doc_id), 1) AS labelled, round(100.0 * count(DISTINCT CASE WHEN contains(text, '@') THEN d.doc_id END) / count(DISTINCT d.doc_id), 1) AS contact FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def coverage_percent(t: Tables) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id", "left")
    n = F.countDistinct("doc_id")
    return j.groupBy("lang").agg(F.round(100 * F.countDistinct(F.when(F.col("quality").isNotNull(), F.col("doc_id"))) / n, 1).alias("labelled"), F.round(100 * F.countDistinct(F.when(F.contains("text", F.lit("@")), F.col("doc_id"))) / n, 1).alias("contact"))


@query("SELECT CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INTEGER) AS year, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders GROUP BY 1")
def per_year(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00') AS undated")
def undated_remainder(t: Tables) -> DataFrame:
    return t.orders.agg((F.count("*") - F.count_if(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))).alias("undated"))


@query("""WITH c AS (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, lower(brand)) AS k FROM c)
SELECT CASE WHEN k <= 8 THEN brand ELSE 'Other' END AS brand, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def fold_other(t: Tables) -> DataFrame:
    return R.fold_other(t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")), "brand", "n", 8)


@query("SELECT p_type AS type, sum(CASE WHEN p_size < 20 THEN 1 ELSE 0 END)::BIGINT AS small, sum(CASE WHEN p_size >= 20 THEN 1 ELSE 0 END)::BIGINT AS large FROM part GROUP BY p_type")
def pivot_two_way(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("type")).agg(F.count_if(F.col("p_size") < 20).alias("small"), F.count_if(F.col("p_size") >= 20).alias("large"))


@query("""WITH b AS (SELECT o_custkey, max(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS best FROM orders GROUP BY o_custkey)
SELECT step, count(*) AS n FROM b JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS step) ON best >= step GROUP BY step""")
def ladder_cumulative(t: Tables) -> DataFrame:
    return R.ladder(t.orders, "o_custkey", 5 - F.substring("o_orderpriority", 1, 1).cast("int"), 5)


@query("SELECT lang, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def text_bytes(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM c)
SELECT p_brand AS brand, sum(n)::BIGINT AS n, string_agg(CASE WHEN k <= 3 THEN p_type END, '|' ORDER BY k) AS top FROM r GROUP BY p_brand""")
def family_table(t: Tables) -> DataFrame:
    c = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "p_type"))))
    return c.groupBy(F.col("p_brand").alias("brand")).agg(F.sum("n").alias("n"), F.array_join(F.transform(top, lambda x: x["p_type"]), "|").alias("top"))


@query("""WITH c AS (SELECT lower(trim(p_name)) AS norm, p_name AS form, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, form) AS k FROM c) SELECT norm, form, n FROM r WHERE k = 1""")
def canonical_spelling(t: Tables) -> DataFrame:
    return R.canonical_form(t.part, F.lower(F.trim("p_name")), "p_name")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE k = 1""")
def latest_by_key(t: Tables) -> DataFrame:
    return R.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) AS with_done FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def entity_counts(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("c_custkey"))).alias("with_done"))


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM c)
SELECT event_type, user_id, n, rank FROM r WHERE rank <= 25""")
def trending_week(t: Tables) -> DataFrame:
    week = t.events.filter(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return R.ranked(week, ["event_type"], [F.desc("n"), "user_id"], 25)


@query("""WITH s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT ts::DATE AS day, count(*) AS checks, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS ok FROM events GROUP BY 1),
u AS (SELECT s.day, coalesce(checks, 0) AS checks, coalesce(ok, 0) AS ok, round(ok / nullif(checks, 0), 4) AS uptime FROM s LEFT JOIN c ON s.day = c.day)
SELECT 'site' AS site, day, checks, ok, uptime, CASE WHEN checks = 0 THEN 'none' WHEN uptime >= 0.99 THEN 'up' WHEN uptime >= 0.5 THEN 'partial' ELSE 'down' END AS state FROM u""")
def daily_uptime_spine(t: Tables) -> DataFrame:
    e = t.events.select(F.lit("site").alias("site"), "ts", "event_type")
    return T.daily_spine(e, "site", F.to_date("ts"), F.col("event_type") != "error", "2024-01-01", "2024-02-04")


@query("SELECT user_id, round(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / count(*), 4) AS uptime FROM events GROUP BY user_id")
def overall_uptime(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 4).alias("uptime"))


@query("""SELECT l_partkey AS partkey, min(l_shipdate) AS first, bool_or(l_returnflag = 'R') AS returned, max(CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END) AS scope, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_partkey""")
def dependency_merge(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("partkey")).agg(F.min("l_shipdate").alias("first"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max(F.when(F.col("l_linestatus") == "O", 2).otherwise(1)).alias("scope"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("""WITH m AS (SELECT (quality = toxic) AS same, quality, toxic FROM labels) SELECT round(sum(CASE WHEN same THEN 1 ELSE 0 END) / count(*), 6) AS accuracy,
round(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) / nullif(sum(quality), 0), 6) AS p, round(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) / nullif(sum(toxic), 0), 6) AS r FROM m""")
def one_class_measures(t: Tables) -> DataFrame:
    both = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1))
    return t.labels.agg(F.round(F.count_if(F.col("quality") == F.col("toxic")) / F.count("*"), 6).alias("accuracy"), F.round(F.try_divide(both, F.sum("quality")), 6).alias("p"), F.round(F.try_divide(both, F.sum("toxic")), 6).alias("r"))


@query("SELECT lang, min(n_chars) AS low, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS high, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def quartiles(t: Tables) -> DataFrame:
    p = F.percentile("n_chars", [0.25, 0.5, 0.75])
    out = t.documents.groupBy("lang").agg(F.min("n_chars").alias("low"), p.alias("p"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 4).alias("mean"))
    return out.select("lang", "low", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"), "high", "mean")


@query("SELECT user_id, ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def daily_caps(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") > F.lit("2024-01-29").cast("timestamp_ntz")).groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).filter("n >= 2")


@query("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'success' WHEN 2 THEN 'pending' ELSE 'failure' END AS state FROM orders GROUP BY o_custkey")
def combined_state(t: Tables) -> DataFrame:
    worst = F.max(F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3))
    return t.orders.groupBy("o_custkey").agg(worst.alias("w")).select("o_custkey", F.element_at(F.array(F.lit("success"), F.lit("pending"), F.lit("failure")), F.col("w")).alias("state"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def calendar_counts(t: Tables) -> DataFrame:
    return t.events.filter("event_type <> 'view'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_monday(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, role, n FROM r WHERE k = 1""")
def thread_latest(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM w WHERE term <> ''),
d AS (SELECT term, count(*) AS df FROM w WHERE term <> '' GROUP BY term) SELECT term, df, round(greatest(0, ln((n + 1) / (df + 0.5)) / ln(n + 1)), 6) AS idf FROM d, n""")
def idf_terms(t: Tables) -> DataFrame:
    terms = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")).filter("term <> ''")
    return R.document_frequency(terms, "doc_id", "term").select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT user_id, least(n, 11) AS bucket, count(*) AS days FROM (SELECT user_id, ts::DATE AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def capped_histogram(t: Tables) -> DataFrame:
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return daily.groupBy("user_id", F.least("n", F.lit(11)).alias("bucket")).agg(F.count("*").alias("days"))


@query("SELECT s_nationkey AS nation, round(avg(CASE WHEN s_name <> '' THEN 1 ELSE 0 END), 4) AS named, round(avg(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END), 4) AS funded FROM supplier GROUP BY 1")
def field_coverage(t: Tables) -> DataFrame:
    return t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.avg((F.col("s_name") != "").cast("int")), 4).alias("named"), F.round(F.avg((F.col("s_acctbal") > 0).cast("int")), 4).alias("funded"))


# -- windows and order


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS in_customer, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS in_priority FROM orders""")
def rank_pairs(t: Tables) -> DataFrame:
    o = [F.desc("o_totalprice"), "o_orderkey"]
    return t.orders.select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy(*o)) - 1).alias("in_customer"), (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(*o)) - 1).alias("in_priority"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day)::BIGINT AS total, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d) SELECT user_id, day, n, total FROM c WHERE k <= 10""")
def star_history(t: Tables) -> DataFrame:
    return T.cumulative(t.events, "user_id", F.to_date("ts"), 10)


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM m WHERE event_type = 'error' GROUP BY user_id, g""")
def incidents_islands(t: Tables) -> DataFrame:
    return T.islands(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "ts")


@query("""WITH p AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS r, lag(text) OVER w AS x, lag(turn) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat_ws(',', CASE WHEN role IS DISTINCT FROM r THEN 'role' END, CASE WHEN text IS DISTINCT FROM x THEN 'text' END) AS changed FROM p WHERE b IS NOT NULL""")
def version_lag_diff(t: Tables) -> DataFrame:
    return T.version_diff(t.conversations, "conv_id", "turn", ["role", "text"])


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS day FROM orders), u AS (SELECT day, o_orderkey, day * 100000 + row_number() OVER (PARTITION BY day ORDER BY o_orderkey) - 1 AS id FROM d WHERE o_orderpriority = '1-URGENT'),
m AS (SELECT day, max(id) - day * 100000 AS top FROM u GROUP BY day), f AS (SELECT * FROM d WHERE o_orderpriority <> '1-URGENT')
SELECT o_orderkey, f.day * 100000 + row_number() OVER (PARTITION BY f.day ORDER BY o_orderkey) + coalesce(top, -1) AS id FROM f LEFT JOIN m ON f.day = m.day""")
def sequential_ids(t: Tables) -> DataFrame:
    days = t.orders.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("day"))
    by_day = F.row_number().over(Window.partitionBy("day").orderBy("o_orderkey"))
    used = days.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("day") * 100000 + by_day - 1).alias("id"))
    return T.new_keys(days.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "day"), used, "o_orderkey", "day")


@query("""WITH s AS (SELECT l_suppkey, l_orderkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM lineitem)
SELECT l_suppkey, l_orderkey, l_partkey, total, total <= 500 AS sent FROM s""")
def budget_cut(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return T.budget_cut(rows, ["l_suppkey"], [F.desc("l_orderkey"), "l_linenumber", "l_partkey", "q"], "q", 500).drop("q", "l_linenumber")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) SELECT user_id, event_id, rank FROM r WHERE rank <= 30""")
def latest_n_per_key(t: Tables) -> DataFrame:
    return R.ranked(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).drop("ts")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def priority_page(t: Tables) -> DataFrame:
    prio = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.orderBy(prio, F.desc("o_totalprice"), "o_orderkey").offset(25).limit(50).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 40")
def keyset_page(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey < 5000").orderBy(F.desc("o_orderkey")).limit(40).select("o_orderkey")


@query("SELECT count(*) AS seen, count(*) <= 500 AS complete FROM (SELECT 1 FROM documents WHERE lang = 'en' LIMIT 501)")
def window_plus_one(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").limit(501).agg(F.count("*").alias("seen"), (F.count("*") <= 500).alias("complete"))


# -- sets and maintenance


@query("SELECT DISTINCT lang, source FROM documents UNION SELECT DISTINCT 'all', source FROM documents")
def union_distinct(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").unionByName(t.documents.select(F.lit("all").alias("lang"), "source")).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.filter("s_acctbal > 5000").select("s_nationkey"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS k, p_partkey FROM part) SELECT p_brand, p_partkey FROM r WHERE k = 1""")
def unique_ignoring_case(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_brand").alias("_k")).agg(F.min_by("p_brand", "p_partkey").alias("p_brand"), F.min("p_partkey").alias("p_partkey")).drop("_k")


@query("""SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NULL THEN a.s_name WHEN b.s_name = '' THEN a.s_name ELSE b.s_name END AS s_name, CASE WHEN b.s_suppkey IS NULL THEN a.s_acctbal ELSE coalesce(b.s_acctbal, a.s_acctbal) END AS s_acctbal
FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey < 18) a FULL OUTER JOIN (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN '' ELSE s_name || '!' END AS s_name, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal + 1 END AS s_acctbal FROM supplier WHERE s_nationkey > 6) b ON a.s_suppkey = b.s_suppkey""")
def upsert_keep_filled(t: Tables) -> DataFrame:
    old = t.supplier.filter("s_nationkey < 18").select("s_suppkey", "s_name", "s_acctbal")
    b = F.col("s_acctbal")
    new = t.supplier.filter("s_nationkey > 6").select("s_suppkey", F.when(b > 5000, "").otherwise(F.concat("s_name", F.lit("!"))).alias("s_name"), F.when(~(b < 0), b + 1).alias("s_acctbal"))
    return D.upsert(old, new, ["s_suppkey"], keep_filled=True)


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src4') a
FULL OUTER JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN text || '.' ELSE text END) AS h FROM documents WHERE source <> 'src5') b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h""")
def row_hash_delta(t: Tables) -> DataFrame:
    state = t.documents.filter("source <> 'src4'").select("doc_id", D.row_hash("text").alias("digest"))
    now = t.documents.filter("source <> 'src5'").withColumn("text", F.when(F.col("lang") == "es", F.concat("text", F.lit("."))).otherwise(F.col("text"))).select("doc_id", D.row_hash("text").alias("digest"))
    return D.delta(state, now, "doc_id")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'withdrawn' WHEN a.c_custkey IS NOT NULL AND a.v <> b.v THEN 'superseded' ELSE 'current' END AS status FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_nationkey <> 5) a
FULL OUTER JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_nationkey <> 7) b ON a.c_custkey = b.c_custkey""")
def status_transition(t: Tables) -> DataFrame:
    old = t.customer.filter("c_nationkey <> 5").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = t.customer.filter("c_nationkey <> 7").select("c_custkey", F.when(F.col("c_acctbal") < 0, "X").otherwise(F.col("c_mktsegment")).alias("v"))
    return D.transition(old, new, "c_custkey", "v")


@query("""SELECT user_id, array_to_string(list_reverse((list(event_id ORDER BY ts DESC, event_id DESC))[1:5]), ',') AS last FROM events GROUP BY user_id""")
def ring_trimmed(t: Tables) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    return R.ranked(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).groupBy("user_id").agg(ids.alias("e")).select("user_id", F.array_join(D.ring(F.col("e"), 5), ",").alias("last"))


@query("""SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IN (1, 2) AND s_acctbal > 0) UNION ALL SELECT s_suppkey + 1000, s_nationkey FROM supplier WHERE s_nationkey IN (1, 2) AND s_acctbal > 0""")
def replace_partition(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_nationkey")
    new = t.supplier.filter("s_nationkey in (1, 2) and s_acctbal > 0").select((F.col("s_suppkey") + 1000).alias("s_suppkey"), "s_nationkey")
    return D.replace_partition(s, new, "s_nationkey")


# -- scalar functions


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host FROM pages")
def url_host(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.url_parts(F.col("url"))["host"].alias("host"))


@query("SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s\"''<>]+')) AS n FROM pages")
def links_in_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(S.links(F.col("html"))).alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[email]', 'g')) AS masked FROM documents WHERE contains(text, '@')")
def mask_emails(t: Tables) -> DataFrame:
    return t.documents.filter(F.contains("text", F.lit("@"))).select("doc_id", F.md5(S.mask_emails(F.col("text"))).alias("masked"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') || '99' AS BIGINT) AS upto, CAST(strftime(o_orderdate, '%Y') || '0000' AS BIGINT) AS since FROM orders")
def day_keys(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.day_key(F.date_format("o_orderdate", "yyyy-MM"), end=True).alias("upto"), S.day_key(F.date_format("o_orderdate", "yyyy")).alias("since"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, 'zzlg' || substr(sha1(lower(trim(regexp_replace(lang, '\\s+', ' ', 'g')))), 1, 12) AS token FROM documents")
def facet_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.facet_token("lg", F.col("lang")).alias("token"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def digest_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS told FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)")
def relative_times(t: Tables) -> DataFrame:
    s = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", S.relative_time(s).alias("told"))


# -- search and similarity


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'stupid') OR list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'license')")
def search_words(t: Tables) -> DataFrame:
    toks = F.split(F.lower("text"), "[^a-z0-9]+")
    return t.documents.filter((Q.may_hold(F.col("text"), ["stupid"]) & Q.has_word(toks, "stupid")) | (Q.may_hold(F.col("text"), ["license"]) & Q.has_word(toks, "license"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])apache[^a-z0-9]+license($|[^a-z0-9])')")
def search_phrase(t: Tables) -> DataFrame:
    return t.documents.filter(Q.stands(F.col("text"), ["apache", "license"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])licen') AND NOT list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'apache')")
def search_prefix_not(t: Tables) -> DataFrame:
    toks = F.split(F.lower("text"), "[^a-z0-9]+")
    return t.documents.filter(Q.may_hold(F.col("text"), ["licen"]) & Q.has_prefix(toks, "licen") & ~Q.has_word(toks, "apache")).select("doc_id")


@query("""WITH s AS (SELECT lang, source FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'license') AND source IN ('src1', 'src2', 'src3', 'src4', 'src5') ORDER BY n_chars DESC, doc_id LIMIT 500),
c AS (SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM s GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY source), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM c) SELECT facet, value, n, rank FROM r WHERE rank <= 20""")
def search_facet_window(t: Tables) -> DataFrame:
    toks = F.split(F.lower("text"), "[^a-z0-9]+")
    return Q.faceted(t.documents, Q.may_hold(F.col("text"), ["license"]) & Q.has_word(toks, "license"), {"source": ["src1", "src2", "src3", "src4", "src5"]}, ["lang", "source"], [F.desc("n_chars"), "doc_id"], 500, 20)


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS k FROM documents), f AS (SELECT doc_id, len(k) AS n, len(list_filter(k, lambda x: x = 'license')) AS a, len(list_filter(k, lambda x: x = 'version')) AS b FROM d),
s AS (SELECT count(*) AS total, avg(n) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM f)
SELECT doc_id, round(-((CASE WHEN ln((total - da + 0.5) / (da + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - da + 0.5) / (da + 0.5)) END) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + (CASE WHEN ln((total - db + 0.5) / (db + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - db + 0.5) / (db + 0.5)) END) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f, s WHERE a > 0 AND b > 0""")
def bm25_scores(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "").alias("k"))
    return Q.bm25(d, "doc_id", "k", ["license", "version"])


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS doc, 'part' AS kind, l_partkey AS term FROM lineitem UNION SELECT DISTINCT l_orderkey, 'supplier', l_suppkey FROM lineitem), n AS (SELECT count(DISTINCT doc) AS n FROM k),
w AS (SELECT kind, term, CASE kind WHEN 'part' THEN 3.0 ELSE 1.0 END * ln(1 + n / count(*)) AS w, count(*) <= 300 AND count(*) <= n / 2 AS rare FROM k, n GROUP BY kind, term, n HAVING count(*) > 1), b AS (SELECT doc, kind, term, w, rare FROM k JOIN w USING (kind, term)),
c AS (SELECT DISTINCT a.doc, b.doc AS other FROM b a JOIN b ON a.kind = b.kind AND a.term = b.term AND a.doc <> b.doc WHERE a.rare), p AS (SELECT c.doc, c.other, round(sum(x.w), 6) AS score FROM c JOIN b x ON x.doc = c.doc JOIN b y ON y.doc = c.other AND y.kind = x.kind AND y.term = x.term GROUP BY 1, 2 HAVING round(sum(x.w), 6) >= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, other) AS rank FROM p) SELECT doc, other, score, rank FROM r WHERE rank <= 10""")
def similar_by_shared_keys(t: Tables) -> DataFrame:
    keys = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("term")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("term")))).alias("k")).select("doc", "k.*")
    return R.similar(keys, "doc", "kind", "term", {"part": 3.0, "supplier": 1.0}, 300, 10, 30.0)


@query("""WITH a AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS t FROM benchmark), na AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
p AS (SELECT x.item_id, y.item_id AS match, count(*) AS k FROM a x JOIN a y ON x.t = y.t GROUP BY 1, 2), s AS (SELECT p.item_id, match, round(k / (x.n + y.n - k), 6) AS score FROM p JOIN na x ON x.item_id = p.item_id JOIN na y ON y.item_id = match),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, match) AS rank FROM s WHERE score >= 0.05) SELECT item_id, match, score, rank FROM r WHERE rank <= 5""")
def jaccard_top_k(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.split(F.lower("text"), "[^a-z]+").alias("k"))
    return R.jaccard_top_k(b, b, "item_id", "k", 5, 0.05)


# -- no single SQL statement: tested against plain versions


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('second', ts), event_id) AS k FROM events),
f AS (SELECT *, s AS last, true AS keep FROM e WHERE k = 1 UNION ALL SELECT e.*, CASE WHEN e.s - f.last >= 86400 THEN e.s ELSE f.last END, e.s - f.last >= 86400 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1) SELECT user_id, event_type, event_id FROM f WHERE keep""")
def event_dedup_24h(t: Tables) -> DataFrame:
    return T.kept_events(t.events, ["user_id", "event_type"], "ts", "event_id", 86400)


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'swh:1:cnt:' || sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) END AS content_id FROM documents""")
def content_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.content_id(F.col("text")).alias("content_id"))


@query("""SELECT page_id, CAST(CAST('0x' || substr(sha256(url), 1, 2) AS INTEGER) % 64 AS INTEGER) AS shard FROM pages""")
def shard_numbers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.shard(F.col("url")).alias("shard"))
