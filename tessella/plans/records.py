"""Whole documents from many inputs, erasure through declared references and deliveries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import erasure as E
from ..sources.delivery import Delivery
from ..sources.tables import fresh
from .catalogue import Tables, query


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


_WHOLE = """WITH base AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS segment, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
orders_ AS (SELECT o_custkey AS k, {'items': list({'order': o_orderkey, 'status': o_orderstatus, 'day': strftime(o_orderdate, '%Y-%m-%d')} ORDER BY o_orderdate DESC, o_orderkey)[1:10], 'partial': count(*) > 10} AS orders FROM orders GROUP BY 1),
spent_ AS (SELECT o_custkey AS k, {'n': count(*), 'first': min(strftime(o_orderdate, '%Y-%m-%d')), 'last': max(strftime(o_orderdate, '%Y-%m-%d')), 'total': sum(o_totalprice::DECIMAL(18,2))::VARCHAR} AS spent FROM orders GROUP BY 1),
events_ AS (SELECT user_id AS k, {'items': list({'id': event_id, 'type': event_type} ORDER BY ts DESC, event_id DESC)[1:10], 'partial': count(*) > 10} AS events FROM events GROUP BY 1),
counts_ AS (SELECT user_id AS k, {'n': count(*), 'types': count(DISTINCT event_type)} AS event_counts FROM events GROUP BY 1),
lines_ AS (SELECT l_partkey AS k, {'items': list({'order': l_orderkey, 'line': l_linenumber, 'supplier': l_suppkey} ORDER BY l_orderkey, l_linenumber, l_suppkey)[1:5], 'partial': count(*) > 5} AS lines FROM lineitem GROUP BY 1),
supplied_ AS (SELECT l_suppkey AS k, {'n': count(*), 'quantity': sum(l_quantity::BIGINT)::BIGINT} AS supplied FROM lineitem GROUP BY 1),
document_ AS (SELECT doc_id AS k, {'lang': lang, 'source': source, 'chars': n_chars, 'sha': sha256(coalesce("text", ''))} AS document FROM documents),
labels_ AS (SELECT doc_id AS k, {'quality': quality, 'toxic': toxic} AS labels FROM labels),
conversation_ AS (SELECT conv_id AS k, {'items': list({'turn': turn, 'role': role} ORDER BY turn)[1:4], 'partial': count(*) > 4} AS conversation FROM conversations GROUP BY 1),
page_ AS (SELECT page_id AS k, {'url': url} AS page FROM pages),
vector_ AS (SELECT vec_id AS k, {'label': label} AS vector FROM embeddings),
benchmark_ AS (SELECT item_id AS k, {'sha': sha256("text")} AS benchmark FROM benchmark),
w AS (SELECT * FROM base LEFT JOIN orders_ o ON o.k = id LEFT JOIN spent_ s ON s.k = id LEFT JOIN events_ e ON e.k = id LEFT JOIN counts_ c ON c.k = id LEFT JOIN lines_ l ON l.k = id LEFT JOIN supplied_ u ON u.k = id
LEFT JOIN document_ d ON d.k = id LEFT JOIN labels_ b ON b.k = id LEFT JOIN conversation_ v ON v.k = id LEFT JOIN page_ p ON p.k = id LEFT JOIN vector_ x ON x.k = id LEFT JOIN benchmark_ m ON m.k = id)
SELECT id, to_json({'benchmark': benchmark, 'conversation': conversation, 'document': document, 'event_counts': event_counts, 'id': id, 'labels': labels, 'lines': lines, 'nation': nation, 'orders': orders, 'page': page, 'segment': segment, 'spent': spent, 'supplied': supplied, 'title': title, 'vector': vector})::VARCHAR AS content,
to_json(events)::VARCHAR AS latest, sha256(to_json({'benchmark': benchmark, 'conversation': conversation, 'document': document, 'event_counts': event_counts, 'id': id, 'labels': labels, 'lines': lines, 'nation': nation, 'orders': orders, 'page': page, 'segment': segment, 'spent': spent, 'supplied': supplied, 'title': title, 'vector': vector})::VARCHAR) AS digest FROM w"""


@query(_WHOLE)
def whole_documents(t: Tables) -> DataFrame:
    """Thirteen tables' rows of one key as a document each; the latest events do not change the digest."""
    nations = t.nation.select("n_nationkey", F.col("n_name").alias("nation"))
    base = t.customer.join(nations, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"), "nation")
    inputs = [
        A.many(t.orders, "o_custkey", "orders", [F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), _day("o_orderdate").alias("day")], [F.desc("o_orderdate"), "o_orderkey"], 10),
        A.folded(t.orders, "o_custkey", "spent", [F.count("*").alias("n"), F.min(_day("o_orderdate")).alias("first"), F.max(_day("o_orderdate")).alias("last"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("total")]),
        A.many(t.events, "user_id", "events", [F.col("event_id").alias("id"), F.col("event_type").alias("type")], [F.desc("ts"), F.desc("event_id")], 10),
        A.folded(t.events, "user_id", "event_counts", [F.count("*").alias("n"), F.size(F.collect_set("event_type")).alias("types")]),
        A.many(t.lineitem, "l_partkey", "lines", [F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier")], ["l_orderkey", "l_linenumber", "l_suppkey"], 5),
        A.folded(t.lineitem, "l_suppkey", "supplied", [F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")]),
        A.one(t.documents.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), "doc_id", "document", [F.col("lang"), F.col("source"), F.col("n_chars").alias("chars"), F.col("_sha").alias("sha")], ["_sha"]),
        A.one(t.labels, "doc_id", "labels", [F.col("quality"), F.col("toxic")], ["quality", "toxic"]),
        A.many(t.conversations, "conv_id", "conversation", [F.col("turn"), F.col("role")], ["turn"], 4),
        A.one(t.pages, "page_id", "page", [F.col("url")], ["url"]),
        A.one(t.embeddings, "vec_id", "vector", [F.col("label")], ["label"]),
        A.one(t.benchmark.withColumn("_sha", F.sha2("text", 256)), "item_id", "benchmark", [F.col("_sha").alias("sha")], ["_sha"]),
    ]
    whole = A.assemble(base, "id", inputs, volatile=["events"])
    told = sorted(c for c in whole.columns if c not in ("events", "digest"))
    nulls = {"ignoreNullFields": "false"}
    return whole.select("id", F.to_json(F.struct(*told), nulls).alias("content"), F.to_json("events", nulls).alias("latest"), "digest")


KEYS = {"customer": ["c_custkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id"]}
#: A customer's orders, their lines and its name in events go; a nation without customers goes with
#: its suppliers, and these with their lines; an order that has lost all its lines goes too.
REFS = [
    E.Ref("orders", ("o_custkey",), "customer", ("c_custkey",)),
    E.Ref("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    E.Ref("customer", ("c_nationkey",), "nation", ("n_nationkey",), "orphan"),
    E.Ref("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    E.Ref("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    E.Ref("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "orphan"),
    E.Ref("events", ("user_id",), "customer", ("c_custkey",), "mask"),
]
_GONE = """WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0 OR c_nationkey < 3),
n AS (SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c))),
s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)), a AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM a) OR l_suppkey IN (SELECT s_suppkey FROM s)),
o AS (SELECT o_orderkey FROM a UNION SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM s)))"""


def _gone(t: Tables) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    tables = {k: getattr(t, k) for k in KEYS}
    seeds = {"customer": t.customer.filter("c_acctbal < 0 or c_nationkey < 3").select("c_custkey")}
    return tables, E.closure(tables, KEYS, REFS, seeds)


@query(f"""{_GONE} SELECT 'customer' AS tbl, c_custkey::VARCHAR AS row_key FROM c UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM n UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM s UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM o
UNION ALL SELECT 'lineitem', l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber FROM l""")
def erasure_closure(t: Tables) -> DataFrame:
    """Every row that goes with the customers to be forgotten, over a graph of six tables."""
    _, gone = _gone(t)
    keyed = {k: df if set(df.columns) == set(KEYS[k]) else df.select(*KEYS[k]).distinct() for k, df in gone.items() if k != "events"}
    told = [df.select(F.lit(k).alias("tbl"), F.concat_ws("/", *KEYS[k]).alias("row_key")) for k, df in keyed.items()]
    out = told[0]
    for df in told[1:]:
        out = out.unionByName(df)
    return out


@query(f"""{_GONE} SELECT 'event' AS kind, event_id AS id, CASE WHEN user_id IN (SELECT c_custkey FROM c) THEN NULL ELSE user_id END AS of_id FROM events UNION ALL SELECT 'order', o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'line', l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) AND l_suppkey NOT IN (SELECT s_suppkey FROM s)""")
def after_erasure(t: Tables) -> DataFrame:
    """What is left of three tables: events without the forgotten users' names, orders, lines."""
    tables, gone = _gone(t)
    left = E.erased({k: tables[k] for k in ("events", "orders", "lineitem")}, KEYS, REFS, gone)
    event = left["events"].select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("of_id"))
    order = left["orders"].select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("of_id"))
    line = left["lineitem"].select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("of_id"))
    return event.unionByName(order).unionByName(line)


CHUNK = 250_000


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey % 10 <> 0),
c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'withdrawn' WHEN a.o_orderkey IS NULL THEN 'new' WHEN (a.o_custkey, a.o_orderstatus, a.day) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.day) THEN 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, change, (row_number() OVER (ORDER BY CASE change WHEN 'withdrawn' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END, o_orderkey) - 1) // 250000 AS chunk FROM c WHERE change IS NOT NULL""")
def second_delivery(t: Tables) -> DataFrame:
    """What a second delivery of orders has to send after a first one was accepted, chunk by chunk."""
    spark = t.orders.sparkSession
    fields = ["o_orderkey", "o_custkey", "o_orderstatus", _day("o_orderdate").alias("day")]
    first = t.orders.filter("o_orderdate < timestamp_ntz '1996-01-01 00:00:00'").select(*fields)
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    second = t.orders.filter("o_custkey % 10 <> 0").select("o_orderkey", "o_custkey", urgent, fields[3])
    target = fresh(spark, "target")
    d = Delivery(spark, fresh(spark, "delivery"), "o_orderkey", "long")
    d.deliver(first, lambda part, chunk: part.write.parquet(f"{target}/{chunk}"), CHUNK, "2024-01-01")
    return d.pending(second, CHUNK).select("o_orderkey", "change", "chunk")
