"""Full-text search and facets over token arrays, as predicates and score columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import ranked


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def may_hold(text: Column, parts: list[str]) -> Column:
    """Whether all parts stand anywhere in a text: a plain search that spares most texts the splitting."""
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(p)) for p in parts])


def has_word(toks: Column, word: str) -> Column:
    return F.array_contains(toks, word)


def has_prefix(toks: Column, prefix: str) -> Column:
    return F.exists(toks, lambda t: F.startswith(t, F.lit(prefix)))


def phrase_count(toks: Column, words: list[str]) -> Column:
    """How often the words follow each other."""
    if len(words) == 1:
        return F.size(F.filter(toks, lambda t: t == words[0]))
    last = F.greatest(F.size(toks) - len(words) + 1, F.lit(0))
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.try_element_at(toks, i + k) == w for k, w in enumerate(words)])))


def stands(text: Column, words: list[str]) -> Column:
    """Whether words of ASCII letters and digits follow each other in a text, which is read once and not split."""
    gap = "[^a-z0-9]"
    return F.rlike(F.lower(text), F.lit(f"(^|{gap}){f'{gap}+'.join(words)}($|{gap})"))


def has_phrase(toks: Column, words: list[str]) -> Column:
    """The words in sequence; the cheap test that all occur comes first."""
    return reduce(lambda a, b: a & b, [F.array_contains(toks, w) for w in words]) & (phrase_count(toks, words) > 0)


def bm25(docs: DataFrame, key: str, toks: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that have all words; more negative is better.

    One pass gives the corpus's size, mean length and document frequencies (a single row,
    broadcast); the score is then an expression on each row.
    """
    hits = [phrase_count(F.col(toks), [w]).alias(f"tf{k}") for k, w in enumerate(words)]
    rows = docs.select(key, F.size(toks).alias("len"), *hits)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))])
    joined = rows.filter(reduce(lambda a, c: a & c, [F.col(f"tf{k}") > 0 for k in range(len(words))])).join(F.broadcast(stats))

    def part(k: int) -> Column:
        raw = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        tf = F.col(f"tf{k}")
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))

    return joined.select(key, F.round(-reduce(lambda a, c: a + c, [part(k) for k in range(len(words))]), 6).alias("score"))


def faceted(docs: DataFrame, match: Column, facets: dict[str, list[str]], count: list[str], order: list, window: int, top: int) -> DataFrame:
    """facet, value, n, rank over the first ``window`` rows that match and pass the facets
    (values of a facet are alternatives, facets all hold)."""
    passing = reduce(lambda a, b: a & b, [F.col(f).isin(v) for f, v in facets.items()], F.lit(True))
    seen = docs.filter(match & passing).orderBy(*order).limit(window)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in count])).alias("f")
    counts = seen.select(pairs).select("f.*").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return ranked(counts, ["facet"], [F.desc("n"), "value"], top)
