"""Entities of a catalogue: people, affiliations, reviews, owners, data points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import ranked


def pair_people(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """group, left, right, how: people of two lists matched in three passes without reuse.

    Rows are (group, id, orcid, position, name).  First the same identifier, then the same
    name at the same position, then a name that occurs once on either side.  Each pass takes
    its people out of the next by an anti-join; groups never meet each other.
    """
    a = left.select(group, F.col("id").alias("left"), "orcid", "position", F.lower("name").alias("name"))
    b = right.select(group, F.col("id").alias("right"), "orcid", "position", F.lower("name").alias("name"))
    out = []

    def once(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
        return df.groupBy(group, *keys).agg(F.min(mark).alias(mark), F.count("*").alias(f"n_{mark}")).filter(F.col(f"n_{mark}") == 1)

    for how, keys in (("identifier", ["orcid"]), ("position", ["position", "name"]), ("name", ["name"])):
        x, y = (df.filter(S) for df, S in ((a, reduce(lambda p, q: p & q, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys])), (b, reduce(lambda p, q: p & q, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]))))
        met = once(x, keys, "left").join(once(y, keys, "right"), [group, *keys]).select(group, "left", "right", F.lit(how).alias("how"))
        out.append(met)
        a, b = a.join(met.select(group, "left"), [group, "left"], "left_anti"), b.join(met.select(group, "right"), [group, "right"], "left_anti")
    return reduce(DataFrame.unionByName, out)


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the shorter side's, as arrays of words; 0 for an empty side."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def first_filled(sources: list[tuple[str, Column]]) -> Column:
    """value and source of the first source that is neither null nor empty."""
    value = F.coalesce(*[F.nullif(c, F.lit("")) for _, c in sources])
    name = reduce(lambda acc, s: F.when(F.nullif(s[1], F.lit("")).isNotNull(), F.lit(s[0])).otherwise(acc), reversed(sources), F.lit(None).cast("string"))
    return F.struct(value.alias("value"), name.alias("source"))


def precedence(df: DataFrame, by: list[str], method: str, order: list[str], ok: Column) -> DataFrame:
    """Of each group the rows of the strongest method that has any acceptable row."""
    rank = F.coalesce(*[F.when(F.col(method) == m, F.lit(k)) for k, m in enumerate(order)])
    good = df.filter(ok).withColumn("_r", rank).filter("_r is not null")
    return good.withColumn("_b", F.min("_r").over(Window.partitionBy(*by))).filter("_r = _b").drop("_r", "_b")


def decisive_reviews(reviews: DataFrame, by: str, person: str, state: str, at: str, author: str) -> DataFrame:
    """by, approved, changes: each person's latest review that decides; comments never undo it,
    a dismissal does, and authors do not review themselves."""
    told = reviews.filter(F.col(state).isin("approved", "changes", "dismissed") & (F.col(person) != F.col(author)))
    last = told.groupBy(by, person).agg(F.max_by(state, at).alias("s"))
    return last.groupBy(by).agg(F.count_if(F.col("s") == "approved").alias("approved"), F.count_if(F.col("s") == "changes").alias("changes"))


def owners(paths: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """owner, n: paths of each owner; of the rules (line, prefix, owner) that match a path the last counts.

    Prefixes are looked up by equality: a path is spelled out as its own directories.
    """
    parts = F.split(F.col(path), "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    spelled = paths.select(path, F.explode(F.array_distinct(heads)).alias("prefix"))
    best = spelled.join(rules, "prefix").groupBy(path).agg(F.max_by("owner", "line").alias("owner"))
    return best.groupBy("owner").agg(F.count("*").alias("n"))


def threads(events: DataFrame, thread: list[str], at: str, order: str, reason: str, ranks: dict[str, int], state: DataFrame) -> DataFrame:
    """Inbox threads: latest event, count, strongest reason, and whether read since."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    seen = events.withColumn("_rank", F.coalesce(rank[F.col(reason)], F.lit(0)))
    grouped = seen.groupBy(*thread).agg(F.max(at).alias("latest"), F.max_by(order, F.struct(at, order)).alias("last"), F.count("*").alias("n"), F.max_by(reason, F.struct("_rank", reason)).alias("reason"))
    return grouped.join(state, thread, "left").withColumn("unread", F.coalesce(F.col("latest") > F.col("read_at"), F.lit(True))).drop("read_at")


def evidence(clues: DataFrame, by: list[str], role: str, weight: str, threshold: float) -> DataFrame:
    """by, role, score, margin, verdict: additive clues judged per subject.

    Each clue votes a signed weight for a role; the best role stands when its score reaches
    the threshold, else the verdict is ``unknown``.  The margin is its lead on the next role.
    """
    scores = clues.groupBy(*by, role).agg(F.round(F.sum(weight), 6).alias("score"))
    top = ranked(scores, by, [F.desc("score"), role], 2)
    wide = top.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.struct(role, "score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    score = F.col("a.score")
    return wide.select(*by, F.when(score >= threshold, F.col(f"a.{role}")).otherwise("unknown").alias("verdict"), score.alias("score"), F.round(score - F.coalesce("b", F.lit(0.0)), 6).alias("margin"))


def rule_scores(docs: DataFrame, key: str, text: Column, rules: list[tuple[str, str, float]], cap: int) -> DataFrame:
    """key, value, confidence: weighted patterns counted up to a cap; confidence 1 - exp(-s / 2.5).

    The rules are a fixed short list, so they become columns of one pass and no join.
    """
    values = sorted({v for v, _, _ in rules})
    total = {v: reduce(lambda a, b: a + b, [F.least(F.regexp_count(text, F.lit(p)), F.lit(cap)) * w for x, p, w in rules if x == v]) for v in values}
    told = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), total[v].cast("double").alias("s")) for v in values])).alias("t")
    return docs.select(key, told).filter("t.s > 0").select(key, F.col("t.value").alias("value"), F.round(1 - F.exp(-F.col("t.s") / 2.5), 6).alias("confidence"))
