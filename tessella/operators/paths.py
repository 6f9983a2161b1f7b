"""Rules of glob patterns on paths, of which the last that matches wins.

Patterns are those of ownership files: ``*`` and ``?`` stay within a segment, ``**`` spans
segments, a pattern with a slash in it is anchored to the root, one that ends in a slash owns what
is inside, and a name without wildcards owns a file or a folder and its contents.

No path meets every rule.  A rule's plain segments from its root, or, where it is not anchored,
its plain last segment, are its handle: paths give out their folder prefixes and segments, and only
equal handles meet, by a hash join.  Rules without a handle (``*.txt``) go by their end of name, or,
where even that is wild, are few and said to be so.  What meets is tested by the rule's expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules without any handle that a table may have: each of them is tested on every path.
OPEN = 1000
_WILD = "[*?]"


def glob_regex(pattern: Column) -> Column:
    """A pattern as an expression over whole paths; null for a negation, a range or nothing."""
    p = F.regexp_replace(pattern, r"^\\#", "#")
    bad = p.rlike(r"^!|[\[\]]") | (p == "")
    anchored = p.startswith("/") | F.regexp_replace(p, "^/+|/+$", "").contains("/")
    folder = p.endswith("/")
    body = F.regexp_replace(p, "^/+|/+$", "")
    last = F.element_at(F.split(body, "/"), -1)
    plain = F.regexp_replace(body, r"[.+^${}()|\\]", r"\\$0")
    # marks for the stars that span segments, so that single stars are told apart
    marked = F.regexp_replace(F.regexp_replace(plain, r"(^|/)\*\*/(?:\*\*/)*", "$1\x01"), r"(^|/)\*\*$", "$1\x02")
    wild = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    whole = F.replace(F.replace(wild, F.lit("\x01"), F.lit("(?:[^/]+/)*")), F.lit("\x02"), F.lit(".*"))
    tail = F.when(folder, "/.*").when((last == "**") | last.rlike(_WILD), "").otherwise("(?:/.*)?")
    head = F.when(anchored, "^").otherwise("^(?:.*/)?")
    return F.when(bad, F.lit(None)).when((body == "") & anchored, "^.*$").when(body != "", F.concat(head, whole, tail, F.lit("$")))


def handle(pattern: Column) -> Column:
    """(kind, text) by which a rule's paths find it: ``under`` a folder prefix, by a ``name`` that is
    a segment, by an ``end`` of the last segment, or ``any``."""
    p = F.regexp_replace(pattern, r"^\\#", "#")
    anchored = p.startswith("/") | F.regexp_replace(p, "^/+|/+$", "").contains("/")
    parts = F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")
    wild = F.transform(parts, lambda x: x.rlike(_WILD))
    first = F.coalesce(F.nullif(F.array_position(wild, True), F.lit(0)), F.size(parts) + 1)
    root = F.array_join(F.slice(parts, 1, first - 1), "/")
    names = F.filter(parts, lambda x: ~x.rlike(_WILD) & (x != ""))
    suffix = F.regexp_extract(F.element_at(parts, -1), r"^\*(\.[A-Za-z0-9]+)$", 1)
    said = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    return (
        F.when(anchored & (root != ""), said("under", root))
        .when(F.size(names) > 0, said("name", F.element_at(names, -1)))
        .when((suffix != "") & ~p.endswith("/"), said("end", suffix))
        .otherwise(said("any", F.lit("")))
    )


def path_handles(path: Column) -> Column:
    """The handles that a path can be found by."""
    parts = F.split(path, "/")
    under = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.lit("under").alias("kind"), F.array_join(F.slice(parts, 1, n), "/").alias("text")))
    names = F.transform(F.array_distinct(parts), lambda x: F.struct(F.lit("name").alias("kind"), x.alias("text")))
    end = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    other = F.array(F.struct(F.lit("end").alias("kind"), end.alias("text")), F.struct(F.lit("any").alias("kind"), F.lit("").alias("text")))
    return F.concat(under, names, other)


def last_match(paths: DataFrame, rules: DataFrame, path: str, place: str = "place", pattern: str = "pattern") -> DataFrame:
    """(path, place) of the last rule that matches each distinct path; null where none does.

    Null and empty paths match nothing; patterns that are not supported match nothing.
    """
    made = rules.select(F.col(place).alias("place"), glob_regex(F.col(pattern)).alias("regex"), handle(F.col(pattern)).alias("h")).filter("regex is not null")
    if made.filter("h.kind = 'any'").limit(OPEN + 1).count() > OPEN:
        raise ValueError(f"more than {OPEN} rules that any path could match")
    every = paths.select(F.col(path).alias("path")).distinct()
    met = every.filter("path <> ''").select("path", F.explode(path_handles(F.col("path"))).alias("h")).join(made, "h").filter(F.expr("rlike(path, regex)"))
    last = met.groupBy("path").agg(F.max("place").alias("place")).withColumnRenamed("path", "_of")
    return every.join(last, F.col("path") == F.col("_of"), "left").select("path", "place")
