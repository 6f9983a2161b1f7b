"""Registered queries: addresses, advisories, dependencies, upkeep with budgets and ledgers, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import delta as D
from ..operators import relational as R
from ..sources.tables import written
from .catalogue import Tables, money, query


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CASE p_partkey % 5 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.lab.org' WHEN 2 THEN 'huggingface.co/datasets' ELSE 'bitbucket.org' END || '/own' || p_size || '/repo' || (p_partkey % 97) END AS repo,
CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 2 THEN 'data' ELSE 'forge' END AS kind, CASE WHEN p_partkey % 5 < 4 THEN 'Own' || p_size END AS owner, CASE WHEN p_partkey % 5 < 4 THEN 'Repo' || (p_partkey % 97) END AS name FROM part""")
def repository_keys(t: Tables) -> DataFrame:
    path = F.concat(F.lit("Own"), F.col("p_size").cast("string"), F.lit("/Repo"), (F.col("p_partkey") % 97).cast("string"))
    k = F.col("p_partkey") % 5
    url = F.when(k == 0, F.concat(F.lit("git@github.com:"), path, F.lit(".git"))).when(k == 1, F.concat(F.lit("https://gitlab.lab.org/"), path, F.lit("/-/tree/main).")))
    url = url.when(k == 2, F.concat(F.lit("huggingface.co/datasets/"), path, F.lit("/blob/x?y=1"))).when(k == 3, F.concat(F.lit("https://www.bitbucket.org/"), path, F.lit("/src​,"))).otherwise(F.concat(F.lit("https://journal.org/"), path))
    return t.part.select("p_partkey", S.repository(url).alias("r")).select("p_partkey", "r.repo", "r.kind", "r.owner", "r.name")


@query("""SELECT p_partkey, 'https://x.org/a(' || p_size || ')' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/b' END AS url FROM part""")
def clean_urls(t: Tables) -> DataFrame:
    inner = F.concat(F.lit("https://x.org/a("), F.col("p_size").cast("string"), F.lit(")"))
    return t.part.select("p_partkey", S.clean_url(F.when(F.col("p_partkey") % 2 == 0, F.concat(inner, F.lit(")."))).otherwise(F.concat(F.lit(" "), inner, F.lit("/b]),")))).alias("url"))


@query("""WITH dep AS (SELECT DISTINCT l_orderkey AS repo, l_partkey AS package, l_linenumber AS version, l_returnflag AS scope FROM lineitem), adv AS (SELECT p_partkey AS package, p_size % 7 + 1 AS version, p_size AS severity FROM part WHERE p_size > 25)
SELECT repo, d.package, max(severity) AS severity, CASE WHEN bool_or(d.package % 100 = 0) THEN 'dismissed' WHEN bool_and(scope = 'N') THEN 'development' ELSE 'open' END AS state FROM dep d JOIN adv a ON d.package = a.package AND d.version = a.version GROUP BY 1, 2""")
def advisories(t: Tables) -> DataFrame:
    """Alerts of repositories by (package, version): worst severity, and where the triage put them."""
    dep = t.lineitem.select(F.col("l_orderkey").alias("repo"), F.col("l_partkey").alias("package"), F.col("l_linenumber").alias("version"), F.col("l_returnflag").alias("scope")).distinct()
    adv = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("package"), (F.col("p_size") % 7 + 1).alias("version"), F.col("p_size").alias("severity"))
    state = F.when(F.bool_or(F.col("package") % 100 == 0), "dismissed").when(F.bool_and(F.col("scope") == "N"), "development").otherwise("open")
    return dep.join(adv, ["package", "version"]).groupBy("repo", "package").agg(F.max("severity").alias("severity"), state.alias("state"))


@query("""WITH s AS (SELECT l_orderkey AS repo, l_partkey AS package, l_linenumber AS rank, 'v' || l_suppkey AS version, l_returnflag = 'R' AS lock FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY repo, package ORDER BY lock DESC, CASE WHEN lock THEN -rank ELSE rank END, CASE WHEN lock THEN version END DESC, version) AS k, min(rank) OVER (PARTITION BY repo, package) AS first, bool_or(lock) OVER (PARTITION BY repo, package) AS locked FROM s)
SELECT repo, package, version, first, locked FROM r WHERE k = 1""")
def dependency_precedence(t: Tables) -> DataFrame:
    """One dependency from several sources: the last lock entry's version wins, else the first
    source's; of two versions in one place a lock takes the greater text, another the lesser."""
    lock = F.col("l_returnflag") == "R"
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("repo"), F.col("l_partkey").alias("package"))
    version = F.concat(F.lit("v"), F.col("l_suppkey").cast("string"))
    locked = F.max(F.when(lock, F.struct("l_linenumber", version.alias("v"))))["v"]
    first = F.min(F.struct("l_linenumber", version.alias("v")))["v"]
    return s.agg(F.coalesce(locked, first).alias("version"), F.min("l_linenumber").alias("first"), F.bool_or(lock).alias("locked"))


@query("""SELECT l_orderkey AS repo, count(DISTINCT l_partkey) AS packages, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey END) AS direct, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS locked FROM lineitem GROUP BY 1""")
def dependency_summary(t: Tables) -> DataFrame:
    each = t.lineitem.groupBy(F.col("l_orderkey").alias("repo"), "l_partkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("direct"), F.bool_or(F.col("l_returnflag") == "R").alias("locked"))
    return each.groupBy("repo").agg(F.count("*").alias("packages"), F.count_if("direct").alias("direct"), F.count_if("locked").alias("locked"))


@query("""WITH f AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS r FROM part), o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS own FROM orders),
d AS (SELECT DISTINCT l_orderkey AS repo, l_partkey FROM lineitem) SELECT repo, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown, sum(CASE WHEN r <= 1 OR r <= own THEN 1 ELSE 0 END)::BIGINT AS fits, sum(CASE WHEN r > 1 AND r > own THEN 1 ELSE 0 END)::BIGINT AS conflicts
FROM d JOIN f ON d.l_partkey = f.p_partkey JOIN o ON o_orderkey = repo GROUP BY repo""")
def licence_summary(t: Tables) -> DataFrame:
    """How many dependencies a repository's license family may build on."""
    family = F.array(*[F.lit(x) for x in ("permissive", "weak copyleft", "copyleft", "network copyleft", "unknown")])
    deps = t.lineitem.select(F.col("l_orderkey").alias("repo"), "l_partkey").distinct()
    j = deps.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.get(family, F.col("p_size") % 5).alias("other")), "l_partkey").join(t.orders.select(F.col("o_orderkey").alias("repo"), F.get(family, (F.col("o_orderkey") % 4).cast("int")).alias("own")), "repo")
    fits = S.compatible(F.col("own"), F.col("other"))
    return j.groupBy("repo").agg(F.count_if(fits.isNull()).alias("unknown"), F.count_if(fits).alias("fits"), F.count_if(~fits).alias("conflicts"))


@query("""SELECT event_type, sum(CASE WHEN ts < TIMESTAMP '2024-01-23 00:00:00' THEN 1 ELSE 0 END)::BIGINT AS last, sum(CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND (event_type <> 'view') THEN 1 ELSE 0 END)::BIGINT AS new,
sum(CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND (event_type <> 'view') THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND (event_type <> 'view') THEN 1 ELSE 0 END) >= 0.3 * sum(CASE WHEN ts < TIMESTAMP '2024-01-23 00:00:00' THEN 1 ELSE 0 END) AS publish FROM events GROUP BY 1""")
def publish_guard(t: Tables) -> DataFrame:
    """Whether a table's new size may replace the last one's (here by event type)."""
    late = F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")
    n = t.events.groupBy("event_type").agg(F.count_if(~late).alias("last"), F.count_if(late & (F.col("event_type") != "view")).alias("new"))
    return n.withColumn("publish", D.may_publish(F.col("new"), F.col("last"), 0.3))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rule FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND event_type IN ('view', 'click', 'error')), c AS (SELECT *, CASE rule WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS cost FROM e),
b AS (SELECT count(*) * 0.45::DOUBLE AS room, (SELECT count(*) FROM c WHERE rule = 1) AS n1, (SELECT count(*) FROM c WHERE rule = 2) AS n2, (SELECT count(*) FROM c WHERE rule = 3) AS n3 FROM events), b1 AS (SELECT *, least(n1, floor(room / 2)) AS k1 FROM b), b2 AS (SELECT *, least(n2, floor((room - 2 * k1) / 3)) AS k2 FROM b1), b3 AS (SELECT *, least(n3, floor(room - 2 * k1 - 3 * k2)) AS k3 FROM b2),
r AS (SELECT event_id, CASE rule WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END AS room, row_number() OVER (PARTITION BY rule ORDER BY ts, event_id) AS k FROM c, b3)
SELECT event_id FROM r WHERE k <= room""")
def budgeted_deletion(t: Tables) -> DataFrame:
    """Expired events that today's budget of written rows lets go: rules in order, what one leaves goes to the next."""
    kind = F.col("event_type")
    rule = F.when(kind == "view", 1).when(kind == "click", 2).otherwise(3)
    room = 0.45 * t.events.count()
    return D.deletable(t.events, (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & kind.isin("view", "click", "error"), rule, ["ts", "event_id"], {1: 2, 2: 3, 3: 1}, room).select("event_id")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_mktsegment = '' THEN c_name ELSE c_mktsegment END AS segment FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer)""")
def fill_only_empty(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"))
    return D.fill_empty(old, t.customer.select("c_custkey", F.col("c_name").alias("segment")), ["c_custkey"])


@query("""SELECT o_custkey AS target, CAST(o_orderdate AS DATE) AS day, count(*) AS chunks, sum(l)::BIGINT AS rows, sum(l) > 6 AS spent FROM (SELECT o_orderkey, o_custkey, o_orderdate, count(*) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def write_ledger(t: Tables) -> DataFrame:
    """Rows that accepted chunks wrote, by target and day, and whether the day's budget is spent."""
    chunk = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("l"))
    return t.orders.join(chunk, "o_orderkey").groupBy(F.col("o_custkey").alias("target"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("chunks"), F.sum("l").alias("rows"), (F.sum("l") > 6).alias("spent"))


@query("""WITH a AS (SELECT l_orderkey AS entity, l_linenumber AS field, 'src' || l_suppkey AS source, l_partkey % 3 AS level, 0 AS t FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey, l_linenumber, 'new' || l_partkey, l_suppkey % 3, 1 FROM lineitem WHERE l_orderkey % 3 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
d AS (SELECT entity, field, min(source) AS source, level, t FROM u GROUP BY entity, field, level, t), r AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY level DESC, t DESC) AS k FROM d) SELECT entity, field, source, level FROM r WHERE k = 1""")
def field_provenance(t: Tables) -> DataFrame:
    def rows(df: DataFrame, mark: str, named: str, level: str) -> DataFrame:
        return df.groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("field"), (F.col(level) % 3).alias("level")).agg(F.min(F.concat(F.lit(mark), F.col(named).cast("string"))).alias("source"))

    return D.provenance(rows(t.lineitem.filter("l_orderkey % 2 = 0"), "src", "l_suppkey", "l_partkey"), rows(t.lineitem.filter("l_orderkey % 3 = 0"), "new", "l_partkey", "l_suppkey"), ["entity", "field"], "level")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey <> 7""")
def suppression(t: Tables) -> DataFrame:
    """Rows of people who asked to be forgotten go; the list holds digests only."""
    def address(name: str) -> F.Column:
        return S.email_digest(F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit("@x.org")))

    asked = t.customer.filter("c_nationkey = 7").select(address("c_name").alias("digest"))
    return D.suppressed(t.customer, asked, address("c_name"), "digest").select("c_custkey")


@query("""SELECT a.l_orderkey AS doc, count(*) AS shared, string_agg(CAST(a.l_partkey AS VARCHAR), ',' ORDER BY a.l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON b.l_partkey = a.l_partkey AND b.l_orderkey = a.l_orderkey + 1 GROUP BY 1""")
def shared_with_next(t: Tables) -> DataFrame:
    """Keys that two documents share, as a list in order."""
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("k"))
    both = sets.join(sets.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("k").alias("other")), "l_orderkey").withColumn("s", F.array_sort(F.array_intersect("k", "other"))).filter(F.size("s") > 0)
    return both.select(F.col("l_orderkey").alias("doc"), F.size("s").cast("long").alias("shared"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("parts"))


@query("""SELECT l_orderkey, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'R') AS returned, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_returnflag <> 'R') AS kept FROM lineitem GROUP BY 1""")
def snapshot_by_role(t: Tables) -> DataFrame:
    def role(ok: F.Column) -> F.Column:
        return F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("l_partkey").cast("string")))), ","), F.lit(""))

    r = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_orderkey").agg(role(r).alias("returned"), role(~r).alias("kept"))


@query("""WITH c AS (SELECT l_suppkey AS repo, CASE WHEN l_quantity > 45 THEN 3 WHEN l_quantity > 10 THEN 2 ELSE 1 END AS verdict, l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS place FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY verdict DESC, score DESC, place) AS k, count(*) OVER (PARTITION BY repo) AS n FROM c) SELECT repo, verdict, place, n FROM r WHERE k = 1""")
def best_verdict(t: Tables) -> DataFrame:
    """The best candidate of each repository, and how often it was found."""
    q = F.col("l_quantity")
    c = t.lineitem.select(F.col("l_suppkey").alias("repo"), F.when(q > 45, 3).when(q > 10, 2).otherwise(1).alias("verdict"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    best = c.groupBy("repo").agg(F.max_by(F.struct("verdict", "place"), F.struct("verdict", "score", -F.col("place"))).alias("b"), F.count("*").alias("n"))
    return best.select("repo", "b.verdict", "b.place", "n")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY day DESC) AS upto, sum(n) OVER (ORDER BY day DESC) - n AS before FROM d), k AS (SELECT day FROM r WHERE upto <= 40 OR before = 0)
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS q FROM orders) JOIN k ON CAST(o_orderdate AS DATE) = k.day WHERE q <= 40""")
def newest_whole_days(t: Tables) -> DataFrame:
    """The newest rows: whole days while they fit, and of the newest day alone its first."""
    o = t.orders.withColumn("day", F.to_date("o_orderdate"))
    days = o.groupBy("day").agg(F.count("*").alias("n"))
    # one row for each day
    run = days.orderBy(F.desc("day")).limit(41).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("day"))))
    kept = run.filter((F.col("upto") <= 40) | (F.col("upto") == F.col("n"))).select("day")
    return R.ranked(o.join(F.broadcast(kept), "day"), ["day"], ["o_orderkey"], 40).select("o_orderkey", "day")


@query("""SELECT 'lang' AS stratum, lang AS value, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS chosen FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2 UNION ALL SELECT 'source', source, count(*), sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2""")
def stratum_composition(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    each = j.select(F.explode(F.array(F.struct(F.lit("lang").alias("stratum"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("stratum"), F.col("source").alias("value")))).alias("s"), "quality")
    return each.groupBy("s.stratum", "s.value").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("chosen"))


@query("""SELECT s_nationkey AS grp, count(*) AS cases, round(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM supplier GROUP BY 1""")
def external_recall(t: Tables) -> DataFrame:
    """Share of an external list's cases that were found, by group."""
    found = t.lineitem.filter("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("hit", F.lit(1.0))
    return t.supplier.join(found, "s_suppkey", "left").groupBy(F.col("s_nationkey").alias("grp")).agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


@query("""SELECT o_custkey AS repo, CAST(o_orderdate AS DATE) AS day, count(*) AS commits, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS ids FROM orders GROUP BY 1, 2""")
def commits_by_day(t: Tables) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey")))
    return t.orders.groupBy(F.col("o_custkey").alias("repo"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("commits"), F.array_join(F.transform(ids, lambda x: x["o_orderkey"].cast("string")), ",").alias("ids"))


@query("""SELECT p_brand AS language, p_type AS kind, count(*) AS files, sum(p_size)::BIGINT AS added, sum(CASE WHEN p_size > 25 THEN p_size - 25 ELSE 0 END)::BIGINT AS removed, round(100.0 * sum(p_size) / (SELECT sum(p_size) FROM part), 2) AS share FROM part GROUP BY 1, 2""")
def change_summary(t: Tables) -> DataFrame:
    whole = t.part.agg(F.sum("p_size").alias("whole"))
    s = F.col("p_size")
    by = t.part.groupBy(F.col("p_brand").alias("language"), F.col("p_type").alias("kind")).agg(F.count("*").alias("files"), F.sum(s.cast("long")).alias("added"), F.sum(F.when(s > 25, s - 25).otherwise(0).cast("long")).alias("removed"))
    return by.crossJoin(F.broadcast(whole)).withColumn("share", F.round(100.0 * F.col("added") / F.col("whole"), 2)).drop("whole")  # one row is broadcast


@query("""SELECT lower(n_name) AS repo, o_orderpriority AS path, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS ranges FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def ranges_per_path(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.lower("n_name").alias("repo"), F.col("o_orderpriority").alias("path")).agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count("*").alias("ranges"))


@query("""SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS papers FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY papers DESC, s_name""")
def papers_per_repository(t: Tables) -> DataFrame:
    n = t.lineitem.select("l_suppkey", "l_orderkey").distinct().groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("papers"))
    return t.supplier.join(n, "s_suppkey").select("s_suppkey", "s_name", "papers").orderBy(F.desc("papers"), "s_name")


@query("""SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey NOT IN (3, 4) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 2 DAY) AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)""")
def archive_candidates(t: Tables) -> DataFrame:
    """Alive, public, in use, and not asked for lately."""
    last = t.lineitem.agg(F.max("l_shipdate").alias("last"))
    lately = t.lineitem.crossJoin(F.broadcast(last)).filter(F.col("l_shipdate") > F.col("last") - F.expr("INTERVAL 2 DAY")).select(F.col("l_suppkey").alias("s_suppkey")).distinct()  # one row is broadcast
    used = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return t.supplier.filter("s_acctbal > 0 and s_nationkey not in (3, 4)").join(used, "s_suppkey", "left_semi").join(lately, "s_suppkey", "left_anti").select("s_suppkey")


@query("""SELECT o_orderkey, CASE WHEN age >= 90 THEN 'stale' WHEN age >= 30 AND o_orderstatus = 'O' THEN 'recheck' ELSE 'fresh' END AS due FROM (SELECT o_orderkey, o_orderstatus, date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS age FROM orders)""")
def reverification(t: Tables) -> DataFrame:
    """Keys to verify anew by age and state."""
    now = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("now"))
    age = F.datediff("now", F.to_date("o_orderdate"))
    due = F.when(age >= 90, "stale").when((age >= 30) & (F.col("o_orderstatus") == "O"), "recheck").otherwise("fresh")
    return t.orders.crossJoin(F.broadcast(now)).select("o_orderkey", due.alias("due"))  # one row is broadcast


@query("""WITH j AS (SELECT user_id AS kind, event_type AS ref, count(*) AS jobs, max(event_id) AS latest FROM events WHERE event_id > 100 GROUP BY 1, 2) SELECT kind, ref, jobs, latest, CASE WHEN jobs > 20 THEN 'give up' WHEN jobs > 10 THEN 'later' ELSE 'run' END AS outcome FROM j""")
def job_groups(t: Tables) -> DataFrame:
    """Jobs after a cursor, one answer for each (kind, ref) from its latest."""
    j = t.events.filter("event_id > 100").groupBy(F.col("user_id").alias("kind"), F.col("event_type").alias("ref")).agg(F.count("*").alias("jobs"), F.max("event_id").alias("latest"))
    return j.withColumn("outcome", F.when(F.col("jobs") > 20, "give up").when(F.col("jobs") > 10, "later").otherwise("run"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS VARCHAR) AS iso, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS due FROM orders""")
def iso_dates(t: Tables) -> DataFrame:
    """Dates from parts, months as names or numbers; and the day a month later, clamped."""
    d = F.col("o_orderdate")
    month = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "MMMM")).otherwise(F.month(d).cast("string"))
    k = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", S.iso_date(F.year(d), F.when(k > 0, month), F.when(k > 1, F.day(d))).alias("iso"), F.add_months(F.to_date(d), 1).alias("due"))


@query("""SELECT doc_id, strip_accents(lower(lang || 'É ' || source || ' ÑÖ')) AS name FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def folded_names(t: Tables) -> DataFrame:
    return t.documents.filter("lang is not null and source is not null").select("doc_id", S.folded(F.concat("lang", F.lit("É "), "source", F.lit(" ÑÖ"))).alias("name"))


@query("""SELECT p_partkey, CAST(p_partkey AS BIGINT) AS number, p_size % 2 = 0 AS closes FROM part UNION ALL SELECT p_partkey, CAST(p_size AS BIGINT), false FROM part""")
def issue_references(t: Tables) -> DataFrame:
    n, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "Fixes: #").otherwise("about #"), n, F.lit(", see #"), s, F.lit(" not a/b#7 or x#8"))
    return t.part.select("p_partkey", F.explode(S.issue_references(text)).alias("r")).select("p_partkey", "r.number", "r.closes")


@query("""SELECT l_orderkey, l_linenumber, round(1 - pow(2, -(l_quantity / 10) / 4.8), 6) AS score FROM lineitem WHERE l_quantity >= 10""")
def evidence_scores(t: Tables) -> DataFrame:
    d = F.col("l_quantity") / 10
    return t.lineitem.filter("l_quantity >= 10").select("l_orderkey", "l_linenumber", F.round(1 - F.pow(F.lit(2.0), -d / 4.8), 6).alias("score"))


#: Texts that a task pairs with units.
TEXTS = 8192


@query("""WITH w AS (SELECT DISTINCT 'b' || item_id AS unit, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark), p AS (SELECT DISTINCT doc_id AS para, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents),
nu AS (SELECT count(DISTINCT unit) AS n FROM w), np AS (SELECT count(DISTINCT para) AS n FROM p), iu AS (SELECT term, greatest(0, ln((n + 1) / (count(*) + 0.5)) / ln(n + 1)) AS i FROM w, nu WHERE term <> '' GROUP BY term, n), ip AS (SELECT term, greatest(0, ln((n + 1) / (count(*) + 0.5)) / ln(n + 1)) AS i FROM p, np WHERE term <> '' GROUP BY term, n),
s AS (SELECT para, unit, round(sum(iu.i * ip.i), 6) AS score FROM p JOIN w USING (term) JOIN iu USING (term) JOIN ip USING (term) WHERE iu.i > 0.05 AND ip.i > 0.05 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY para ORDER BY score DESC, unit) AS rank FROM s WHERE score >= 1.5) SELECT para, unit, score, rank FROM r WHERE rank <= 3""")
def aligned_units(t: Tables) -> DataFrame:
    """Units for each text by the words they share, idf of both sides multiplied; words that are
    common on either side (0.05 or less) join nothing.

    A text's words that some unit has are written once.  Their weights go with the units' words,
    and the texts' words are dealt by text before they meet these: the pairs of a text and a unit,
    many times as many as the words, are made, summed and ranked where they are.
    """
    spark = t.documents.sparkSession

    def terms(df: DataFrame, key: F.Column, name: str) -> DataFrame:
        return df.select(key.alias(name), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")).filter("term != ''")

    def size(df: DataFrame, key: str) -> DataFrame:
        return df.filter("text is not null").select(key).distinct().agg(F.count("*").alias("n"))

    def weighted(x: DataFrame, n: DataFrame, name: str) -> DataFrame:
        df = x.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row is broadcast
        return df.select("term", F.greatest(F.lit(0.0), F.log((F.col("n") + 1) / (F.col("df") + 0.5)) / F.log(F.col("n") + 1)).alias(name))

    parts = max(spark.sparkContext.defaultParallelism, -(-t.documents.count() // TEXTS))
    w = terms(t.benchmark, F.concat(F.lit("b"), F.col("item_id").cast("string")), "unit").distinct()
    p = terms(t.documents, F.col("doc_id"), "para").join(w.select("term").distinct(), "term", "left_semi")
    p = written(p.select("para", "term").repartition(parts, "para").distinct())  # rows of the same doc_id are one text
    weight = weighted(w, size(t.benchmark, "item_id"), "u").join(weighted(p, size(t.documents, "doc_id"), "v"), "term").filter("u > 0.05 and v > 0.05")
    units = written(w.join(weight, "term").select("unit", "term", (F.col("u") * F.col("v")).alias("weight")))
    score = p.repartition(parts, "para").join(units, "term").groupBy("para", "unit").agg(F.round(F.sum("weight"), 6).alias("score"))
    return R.ranked(score.filter("score >= 1.5"), ["para"], [F.desc("score"), "unit"], 3)


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)) SELECT 'order' AS kind, o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderpriority END AS shown FROM k
UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k) UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM k)""")
def public_projection(t: Tables) -> DataFrame:
    """What may be shown: withdrawn rows go, private values are masked, and rows that hang on nothing left go too."""
    kept = t.orders.filter("o_orderstatus != 'P'")
    orders = kept.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.when(~(F.col("o_totalprice") > 300000), F.col("o_orderpriority")).alias("shown"))
    lines = t.lineitem.join(kept.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.lit("line"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_returnflag")
    people = t.customer.join(kept.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.lit("customer"), F.col("c_custkey"), "c_mktsegment")
    return orders.union(lines).union(people)


@query("""SELECT c_nationkey AS board, c_mktsegment AS field, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS items, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM customer GROUP BY 1, 2""")
def board_groups(t: Tables) -> DataFrame:
    items = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    return t.customer.groupBy(F.col("c_nationkey").alias("board"), F.col("c_mktsegment").alias("field")).agg(F.count("*").alias("n"), items.alias("items"), F.sum(money("c_acctbal")).cast("decimal(28,2)").alias("total"))
