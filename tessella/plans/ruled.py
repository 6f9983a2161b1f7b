"""Classification by a rules table, path rules and exact block fill, each beside its SQL.

The classifier's rules are derived from the benchmark texts: their first word pairs, first words and word
beginnings, so there are five for each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fill as B
from ..operators import paths as A
from ..operators import rules as C
from .catalogue import Tables, query
from .indexed import parted

OWN = "(^|[^a-z0-9])(and|und|et|en|los)($|[^a-z0-9])"


def rules_of(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    w = lambda k: F.try_element_at("k", F.lit(k))
    pair = lambda k: F.concat(w(k), F.lit(" "), w(k + 1))
    rows = t.benchmark.select("item_id", words.alias("k"))
    phrases = F.array(pair(1), pair(3), pair(5), w(2), F.concat(F.substring(w(4), 1, 4), F.lit("*")))
    rows = rows.select("item_id", F.posexplode(phrases).alias("j", "phrase"))
    facet = F.element_at(F.array(F.lit("kind"), F.lit("origin"), F.lit("topic")), (F.col("item_id") % 3 + 1).cast("int"))
    return rows.select((F.col("item_id") * 5 + F.col("j")).alias("rule"), facet.alias("facet"), F.concat(F.lit("v"), (F.col("item_id") + F.col("j")) % 4).alias("value"), (F.lit(0.25) + 0.25 * (F.col("item_id") % 4) + F.when(F.col("j") < 3, 1.0).otherwise(0.0)).alias("weight"), "phrase")


_RULES = """b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS k FROM benchmark),
r AS (SELECT item_id * 5 + j AS rule, ['kind', 'origin', 'topic'][item_id % 3 + 1] AS facet, 'v' || (item_id + j) % 4 AS value, 0.25::DOUBLE + 0.25::DOUBLE * (item_id % 4) + CASE WHEN j < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight, j,
CASE WHEN j < 3 THEN k[2 * j + 1] || ' ' || k[2 * j + 2] WHEN j = 3 THEN k[2] ELSE substr(k[4], 1, 4) END AS phrase FROM b, range(0, 5) q(j)),
d AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(substr(text, length(split_part(text, chr(10), 1)) + 2)) AS body FROM documents),
f AS (SELECT doc_id, 'title' AS field, string_split_regex(title, '[.!?]+[ \\n]+') AS s FROM d WHERE title <> '' UNION ALL SELECT doc_id, 'body', string_split_regex(body, '[.!?]+[ \\n]+') FROM d WHERE body <> ''),
o AS (SELECT doc_id, field, s, coalesce(list_position(list_transform(s, lambda x: regexp_matches(x, '(^|[^a-z0-9])(and|und|et|en|los)($|[^a-z0-9])')), true), 0) - 1 AS own FROM f),
e AS (SELECT doc_id, field, s[i] AS s, i, CASE WHEN own <= greatest(1, len(s) // 2) AND i - 1 < own THEN 0.5 ELSE 1.0 END AS w FROM o, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
k AS (SELECT doc_id, field, i, w, list_filter(string_split_regex(s, '[^a-z0-9]+'), lambda x: x <> '') AS k FROM e),
g AS (SELECT doc_id, field, i, w, k[p] AS one, CASE WHEN p < len(k) THEN k[p] || ' ' || k[p + 1] END AS two FROM k, LATERAL (SELECT unnest(range(1, len(k) + 1)) AS p)),
m AS (SELECT doc_id, field, rule, w FROM g JOIN r ON r.j < 3 AND g.two = r.phrase UNION ALL SELECT doc_id, field, rule, w FROM g JOIN r ON r.j = 3 AND g.one = r.phrase UNION ALL SELECT doc_id, field, rule, w FROM g JOIN r ON r.j = 4 AND length(r.phrase) > 0 AND substr(g.one, 1, length(r.phrase)) = r.phrase),
n AS (SELECT doc_id, field, rule, count(*) AS n, sum(w)::DOUBLE AS amount FROM m GROUP BY ALL)"""
_SCORES = f"""{_RULES},
p AS (SELECT doc_id, facet, value, field, least(sum(CAST(CASE field WHEN 'title' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * weight * CASE WHEN field = 'title' THEN 1.0::DOUBLE WHEN amount <= 1 THEN amount ELSE least(2.0::DOUBLE, 1 + 0.5::DOUBLE * (amount - 1)) END AS DECIMAL(20, 4))), 6) AS part FROM n JOIN r USING (rule) GROUP BY ALL),
c AS (SELECT doc_id, facet, value, round(1 - exp(-sum(part)::DOUBLE / 2.5), 6) AS confidence FROM p GROUP BY ALL)"""


def _found(t: Tables) -> DataFrame:
    return C.matches(parted(t.documents), rules_of(t), "doc_id", ["title", "body"], OWN)


def _scored(t: Tables) -> DataFrame:
    return C.scores(_found(t), rules_of(t), {"title": 3.0, "body": 1.0}, ["title"])


@query(f"WITH {_RULES} SELECT doc_id, field, rule, n, amount FROM n")
def rule_matches(t: Tables) -> DataFrame:
    return _found(t).withColumnRenamed("key", "doc_id")


@query(f"""WITH {_SCORES}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, facet ORDER BY confidence DESC, value) AS rank, lead(confidence) OVER (PARTITION BY doc_id, facet ORDER BY confidence DESC, value) AS next FROM c),
y AS (SELECT *, max(CASE WHEN rank = 1 THEN confidence END) OVER w AS best, max(CASE WHEN rank = 1 THEN next END) OVER w AS second, max(CASE WHEN rank = 1 THEN value END) OVER w AS top FROM x WINDOW w AS (PARTITION BY doc_id, facet))
SELECT doc_id, facet, value, confidence, rank, CASE WHEN facet = 'topic' OR (facet = 'kind' AND top = 'v0') THEN rank = 1 AND confidence >= 0.5 ELSE confidence >= 0.5 AND NOT (facet = 'kind' AND value = 'v0') END AS chosen,
CASE WHEN facet = 'topic' THEN best < 0.5 OR coalesce(second, 0) >= 0.8 * best ELSE best < 0.5 END AS ambiguous FROM y""")
def rule_facets(t: Tables) -> DataFrame:
    return C.decided(_scored(t), ["topic"], exclusive={"kind": "v0"}).withColumnRenamed("key", "doc_id")


@query(f"""WITH {_RULES} SELECT doc_id, round(1 / (1 + exp(-(sum(CAST(CASE WHEN value = 'v1' THEN weight ELSE -weight END * CASE WHEN amount <= 1 THEN amount ELSE least(2.0::DOUBLE, 1 + 0.5::DOUBLE * (amount - 1)) END AS DECIMAL(20, 4)))::DOUBLE - 0.5::DOUBLE))), 6) AS chance FROM n JOIN r USING (rule) WHERE value IN ('v1', 'v2') GROUP BY doc_id""")
def on_topic_margin(t: Tables) -> DataFrame:
    return C.margin(_found(t), rules_of(t), "v1", "v2", -0.5).withColumnRenamed("key", "doc_id")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT coalesce(lang, '') AS lang, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY lang, size, digest) - 1 AS position FROM (SELECT digest, size, min(lang) AS lang FROM c GROUP BY digest, size)),
f AS (SELECT position, size AS used, position AS block FROM o WHERE position = 0
UNION ALL SELECT o.position, CASE WHEN f.used + o.size <= 65536 THEN f.used + o.size ELSE o.size END, CASE WHEN f.used + o.size <= 65536 THEN f.block ELSE o.position END FROM f JOIN o ON o.position = f.position + 1)
SELECT digest, size, position, block FROM o JOIN f USING (position)""")
def block_fill(t: Tables) -> DataFrame:
    """Distinct contents in blocks of 64 KiB, by language, size and digest, exactly as one loop fills them."""
    rows = t.documents.filter("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    items = rows.groupBy("digest", "size").agg(F.min("lang").alias("lang"))
    return B.filled(items, ["lang", "size", "digest"], "size", 1 << 16).select("digest", "size", "position", "block")


PATTERNS = ["*", "/www.*/en/", "*.html", "blog.*/**", "**/fr/*", "de/", "4??", "319", "!es/", "[ab]", "/m.*/**/2*.html"]


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/?([?#].*)?$', '') AS path FROM pages),
h AS (SELECT split_part(path, '/', 1) AS host, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, path, CASE WHEN first % 2 = 0 AND regexp_matches(substr(path, length(host) + 1), '^/.*\.html$') OR first % 2 = 1 AND starts_with(path, host || '/en/') THEN 1000 + first WHEN regexp_matches(path, '^m\.[^/]*/([^/]+/)*2[^/]*\.html$') THEN 10 WHEN regexp_matches(path, '(^|/)319(/.*)?$') THEN 7 WHEN regexp_matches(path, '(^|/)4[^/][^/]$') THEN 6
WHEN regexp_matches(path, '(^|/)de/.') THEN 5 WHEN regexp_matches(path, '^([^/]+/)*fr/[^/]*$') THEN 4 WHEN regexp_matches(path, '^blog\.[^/]*/.') THEN 3 WHEN regexp_matches(path, '\.html$') THEN 2 WHEN regexp_matches(path, '^www\.[^/]*/en/.') THEN 1 ELSE 0 END AS place FROM p JOIN h ON host = split_part(path, '/', 1)""".replace("\\\\", "\\"))
def path_rules(t: Tables) -> DataFrame:
    """The last rule of an ownership list that matches each page's host and path.  The list is a
    fixed head and a rule for each host, so it grows with the table."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/?([?#].*)?$", "")
    pages = t.pages.select("page_id", path.alias("path"))
    fixed = t._spark.createDataFrame(list(enumerate(PATTERNS)), "place long, pattern string")
    hosts = pages.groupBy(F.substring_index("path", "/", 1).alias("host")).agg(F.min("page_id").alias("first"))
    made = hosts.select((F.col("first") + 1000).alias("place"), F.concat(F.lit("/"), "host", F.when(F.col("first") % 2 == 0, "/**/*.html").otherwise("/en/")).alias("pattern"))
    return pages.join(A.last_match(pages, fixed.unionByName(made), "path"), "path").select("page_id", "path", "place")
