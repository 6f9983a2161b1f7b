"""Searches over an index of postings, each beside the SQL that reads all texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings as P
from ..operators import search as Q
from ..sources.tables import fresh, shared_folder
from .catalogue import Tables, query

_made: dict[tuple[str, str], P.Index] = {}
KEPT = ["lang", "source", "n_chars"]


def parted(docs: DataFrame) -> DataFrame:
    """Documents with their first line as title and the rest as body."""
    title = F.substring_index("text", "\n", 1)
    return docs.withColumn("title", title).withColumn("body", F.substr("text", F.length(title) + 2))


def index_of(t: Tables) -> P.Index:
    """The folder's index, built when it is first asked for in an application."""
    spark: SparkSession = t._spark
    key = (spark.sparkContext.applicationId, t._folder)
    if key not in _made:
        index = P.Index(spark, f"{shared_folder(spark)}/index-{hashlib.sha1('|'.join(key).encode()).hexdigest()[:20]}")
        if not index.state:
            index.refresh(parted(t.documents), "doc_id", ["title", "body"], KEPT)
        _made[key] = index
    return _made[key]


_TEXT = "d AS (SELECT doc_id, lang, source, n_chars, lower(split_part(text, chr(10), 1)) AS title, lower(substr(text, length(split_part(text, chr(10), 1)) + 2)) AS body FROM documents)"
_TOKENS = "k AS (SELECT doc_id, list_filter(string_split_regex(title, '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(body, '[^a-z0-9]+'), lambda x: x <> '') AS b FROM d)"


@query(f"WITH {_TEXT}, {_TOKENS} SELECT doc_id FROM k WHERE (list_contains(a, 'stupid') OR list_contains(b, 'stupid') OR list_contains(a, 'license') OR list_contains(b, 'license')) AND (list_contains(a, 'the') OR list_contains(b, 'the'))")
def indexed_words(t: Tables) -> DataFrame:
    index = index_of(t)
    return index.keyed(index.search(["the"], some=["stupid", "license"])).select("doc_id")


@query(f"WITH {_TEXT} SELECT doc_id FROM d WHERE regexp_matches(title, '(^|[^a-z0-9])apache[^a-z0-9]+license($|[^a-z0-9])') OR regexp_matches(body, '(^|[^a-z0-9])apache[^a-z0-9]+license($|[^a-z0-9])')")
def indexed_phrase(t: Tables) -> DataFrame:
    index = index_of(t)
    return index.keyed(index.search(["apache license"])).select("doc_id")


@query(f"WITH {_TEXT}, {_TOKENS} SELECT doc_id FROM k WHERE len(list_filter(a || b, lambda x: starts_with(x, 'licen'))) > 0 AND NOT list_contains(a || b, 'apache')")
def indexed_prefix_not(t: Tables) -> DataFrame:
    index = index_of(t)
    return index.keyed(index.search(["licen*"], none=["apache"])).select("doc_id")


@query(f"""WITH {_TEXT}, {_TOKENS}, f AS (SELECT doc_id, len(a) + len(b) AS n, 10.0 * len(list_filter(a, lambda x: x = 'license')) + len(list_filter(b, lambda x: x = 'license')) AS a, 10.0 * len(list_filter(a, lambda x: x = 'the')) + len(list_filter(b, lambda x: x = 'the')) AS b FROM k),
s AS (SELECT count(*) AS total, avg(coalesce(n, 0)) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM f),
r AS (SELECT doc_id, round(-((CASE WHEN ln((total - da + 0.5) / (da + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - da + 0.5) / (da + 0.5)) END) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + (CASE WHEN ln((total - db + 0.5) / (db + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - db + 0.5) / (db + 0.5)) END) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f, s WHERE a > 0 AND b > 0)
SELECT doc_id, score FROM r ORDER BY score, doc_id LIMIT 20""")
def indexed_bm25_top(t: Tables) -> DataFrame:
    return index_of(t).top(["license", "the"], 20, [10.0, 1.0]).select("doc_id", "score")


@query(f"""WITH {_TEXT}, {_TOKENS}, s AS (SELECT lang, source FROM d JOIN k USING (doc_id) WHERE list_contains(a || b, 'license') AND source IN ('src1', 'src2', 'src3', 'src4', 'src5') ORDER BY n_chars DESC, doc_id LIMIT 500),
c AS (SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM s GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY source), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM c) SELECT facet, value, n, rank FROM r WHERE rank <= 20""")
def indexed_facets(t: Tables) -> DataFrame:
    index = index_of(t)
    found = index.keyed(index.search(["license"]))
    return Q.faceted(found, F.lit(True), {"source": ["src1", "src2", "src3", "src4", "src5"]}, ["lang", "source"], [F.desc("n_chars"), "doc_id"], 500, 20)


@query(f"""WITH {_TEXT}, {_TOKENS} SELECT doc_id, CASE WHEN list_contains(a || b, 'stupid') THEN 'stupid' ELSE 'license' END AS word FROM k WHERE list_contains(a || b, 'stupid') OR list_contains(a || b, 'license')""")
def index_after_refresh(t: Tables) -> DataFrame:
    """An index of another day's table (a source not there yet, one with other texts, rows that are
    gone since) that was brought to this day's, and its entries made one segment."""
    now = parted(t.documents)
    other = F.when(F.col("source") == "src2", F.concat(F.lit("stupid license of old "), "body")).otherwise(F.col("body"))
    before = now.filter("source is null or source <> 'src1'").withColumn("body", other)
    before = before.unionByName(before.filter("lang = 'fr'").withColumn("doc_id", -1 - F.col("doc_id")))
    index = P.Index(t._spark, fresh(t._spark, "index"))
    index.refresh(before, "doc_id", ["title", "body"], KEPT)
    index.refresh(now, "doc_id", ["title", "body"], KEPT)
    index.compact()
    first = index.having("stupid")
    both = first.withColumn("word", F.lit("stupid")).unionByName(index.having("license").join(first, "rowid", "left_anti").withColumn("word", F.lit("license")))
    return index.keyed(both).select("doc_id", "word")
