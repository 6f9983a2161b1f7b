"""Joins, folds and top-k that a catalogue needs, as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, by: list, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1; groups are cut before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def facet_counts(df: DataFrame, facets: list[str], k: int) -> DataFrame:
    """facet, value, n, rank: the ``k`` commonest values of each facet, ties by value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])).alias("f")
    counts = df.select(pairs).select("f.facet", "f.value").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return ranked(counts, ["facet"], [F.desc("n"), "value"], k)


def fold_other(counts: DataFrame, label: str, n: str, k: int, rest: str = "Other") -> DataFrame:
    """Counts by label with all but the ``k`` largest folded into one; ties by lower-case label.

    The first ``k`` are a top-k; what is left over is the total less their sum.
    """
    top = counts.select(label, n).orderBy(F.desc(n), F.lower(F.col(label))).limit(k)
    held = counts.agg(F.sum(n).alias("all"), F.count("*").alias("rows")).crossJoin(F.broadcast(top.agg(F.coalesce(F.sum(n), F.lit(0)).alias("part"))))  # one row
    return top.union(held.filter(F.col("rows") > k).select(F.lit(rest), F.col("all") - F.col("part")))


def ladder(df: DataFrame, key: str, level: Column, steps: int) -> DataFrame:
    """step, n: how many keys have a best level of ``step`` or more."""
    best = df.groupBy(key).agg(F.max(level).alias("best"))
    return best.select(F.explode(F.sequence(F.lit(0), F.least(F.col("best"), F.lit(steps - 1)))).alias("step")).groupBy("step").agg(F.count("*").alias("n"))


def canonical_form(df: DataFrame, norm: Column, form: str) -> DataFrame:
    """norm, form, n: the commonest spelling of each normalised value, ties to the least."""
    counts = df.groupBy(norm.alias("norm"), F.col(form).alias("form")).agg(F.count("*").alias("n"))
    return ranked(counts, ["norm"], [F.desc("n"), "form"], 1).drop("rank")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each group: a partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])


def tree_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: rows added, removed or modified between two snapshots."""
    a, b = old.select(F.col(key), F.col(content).alias("_a"), F.lit(1).alias("_old")), new.select(F.col(key), F.col(content).alias("_b"), F.lit(1).alias("_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


def merge_three(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, content: str) -> DataFrame:
    """key, outcome: which side's change stands, or a conflict where both changed apart."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), F.struct(F.col(content).alias("c")).alias(name))

    x = side(base, "b").join(side(ours, "o"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    ours_same, theirs_same, agree = F.col("o").eqNullSafe(F.col("b")), F.col("t").eqNullSafe(F.col("b")), F.col("o").eqNullSafe(F.col("t"))
    return x.select(key, F.when(ours_same & theirs_same, "unchanged").when(agree, "both").when(theirs_same, "ours").when(ours_same, "theirs").otherwise("conflict").alias("outcome"))


def overlay(base: DataFrame, edits: DataFrame, key: list[str], op: str, value: str) -> DataFrame:
    """Human edits over harvested rows: ``remove`` drops, ``set`` replaces the value, ``add`` appends."""
    told = edits.select(*key, F.col(op).alias("_op"), F.col(value).alias("_value"))
    kept = base.join(told.filter("_op != 'add'"), key, "left").filter("_op is null or _op != 'remove'")
    kept = kept.select(*key, F.when(F.col("_op") == "set", F.col("_value")).otherwise(F.col(value)).alias(value))
    added = told.filter("_op = 'add'").join(base, key, "left_anti").select(*key, F.col("_value").alias(value))
    return kept.unionByName(added)


def best_overlap(new: DataFrame, old: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """For each new interval the old one that overlaps it most (ties to the least key).

    Intervals meet by the cells of a fixed width that they touch, an equi-join, so no group
    is paired whole; a pair that shares several cells is counted in the first of them.
    """
    width = 64

    def cells(df: DataFrame, mark: str) -> DataFrame:
        named = df.select(*by, F.col(key).alias(f"{mark}_key"), F.col(start).alias(f"{mark}_start"), F.col(end).alias(f"{mark}_end"))
        return named.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{mark}_start") / width), F.floor(F.col(f"{mark}_end") / width))))

    both = cells(new, "n").join(cells(old, "o"), [*by, "cell"])
    first = F.floor(F.greatest("n_start", "o_start") / width) == F.col("cell")
    over = both.withColumn("overlap", F.least("n_end", "o_end") - F.greatest("n_start", "o_start") + 1).filter(first & (F.col("overlap") > 0))
    return over.groupBy(*by, "n_key").agg(F.max_by(F.struct("o_key", "overlap"), F.struct("overlap", -F.col("o_key"))).alias("_b")).select(*by, F.col("n_key").alias("key"), F.col("_b.o_key").alias("match"), F.col("_b.overlap").alias("overlap"))


def document_frequency(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """term, df, idf: how many documents have a term, and ln((n + 1) / (df + 0.5)) / ln(n + 1), at least 0."""
    each = terms.select(doc, term).distinct()
    n = each.select(doc).distinct().agg(F.count("*").alias("n"))
    df = each.groupBy(term).agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") + 1) / (F.col("df") + 0.5)) / F.log(F.col("n") + 1))
    return df.join(F.broadcast(n)).select(term, "df", idf.alias("idf"))  # one row is broadcast


#: Postings that a task of :func:`similar` numbers, and lots in which keys are numbered.
POSTINGS, LOTS = 1 << 19, 1 << 16


def similar(postings: DataFrame, doc: str, kind: str, term: str, weights: dict[str, float], most: int, k: int, least: float) -> DataFrame:
    """doc, other, score, rank: documents that share keys, weighted by kind and idf.

    Keys of at most ``most`` documents, and of half of all, find the candidates; *all* shared
    keys score them.  Each document meets others with its whole bag of keys, so a pair is scored
    where it is made, at the first rare key it shares.  A key of more than ``k`` documents gives
    each of them ``k`` others of its weight or more; what stays below that is dropped at once.

    Postings are dealt three times: by key, where they are made one, counted and numbered (a
    number of 32 bits travels for kind and term, below 0 if the key is rare), by document, and
    with what follows in its bag by rare key.  Tasks are as many as keep what each sorts in memory.
    """
    parts = max(postings.sparkSession.sparkContext.defaultParallelism, -(-postings.count() // POSTINGS))
    n = postings.agg(F.count_distinct(doc).alias("n"))
    number = F.create_map(*[F.lit(x) for j, k_ in enumerate(weights) for x in (k_, j)])
    keys = postings.select(F.col(doc).alias("doc"), number[F.col(kind)].cast("tinyint").alias("kind"), F.col(term).alias("term")).filter("kind is not null and term is not null")  # others weigh nothing
    lot = F.pmod(F.xxhash64("kind", "term"), F.lit(LOTS)).cast("int")
    dealt = keys.repartition(parts, lot).withColumn("lot", lot)
    once = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("lot", "kind", "term", "doc").orderBy("doc"))).filter("_k = 1")
    told = once.withColumn("df", F.count("*").over(Window.partitionBy("lot", "kind", "term"))).withColumn("_r", F.dense_rank().over(Window.partitionBy("lot").orderBy("kind", "term")))
    told = told.filter("df > 1 and doc is not null").join(F.broadcast(n))  # one row is broadcast
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights.values()]), F.col("kind") + 1) * F.log(1 + F.col("n") / F.col("df"))
    code = ((F.col("_r") - 1).cast("long") * LOTS + F.col("lot")).cast("int")
    rare = (F.col("df") <= most) & (F.col("df") <= F.col("n") / 2)
    enough = rare & (F.col("df") > k) & F.lit(min(weights.values()) >= 0)
    told = told.select("doc", F.when(rare, -1 - code).otherwise(code).alias("code"), w.alias("w"), enough.alias("enough")).repartition(parts, "doc")
    bags = told.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("code", "w"))).alias("b"), F.coalesce(F.round(F.max(F.when(F.col("enough"), F.col("w"))), 6), F.lit(least)).alias("least"))
    # a rare key goes with the keys after it; a pair that shares one before it is scored there, no lower
    at = bags.select("doc", "least", F.col("b.code").alias("c"), F.col("b.w").alias("v"), F.posexplode(F.filter("b.code", lambda x: x < 0)).alias("at", "code"))
    bag = {"doc": F.col("doc"), "least": F.col("least"), "w": F.col("v")[F.col("at")], "codes": F.slice("c", F.col("at") + 2, F.size("c")), "ws": F.slice("v", F.col("at") + 2, F.size("v"))}
    if min(weights.values()) < 0:
        bag["before"] = F.slice("c", F.lit(1), F.col("at"))
    rows = at.select("code", *[x.alias(c) for c, x in bag.items()]).repartition(parts, "code")
    a, b = (rows.select("code", *[F.col(c).alias(f"{side}_{c}") for c in bag]) for side in "ab")
    pairs = a.join(b, "code").filter("a_doc < b_doc")
    if "before" in bag:
        pairs = pairs.filter(~F.arrays_overlap("a_before", "b_before"))

    def total(side: str) -> Column:
        return F.aggregate(F.array_intersect("a_codes", "b_codes"), F.col(f"{side}_w"), lambda acc, c: acc + F.element_at(f"{side}_ws", F.array_position(f"{side}_codes", c).cast("int")))

    # either side's weights do, the shorter bag is searched; both sides read one exchange
    shared = F.when(F.size("a_codes") <= F.size("b_codes"), total("a")).otherwise(total("b"))
    scores = pairs.select("code", "a_doc", "b_doc", "a_least", "b_least", F.round(shared, 6).alias("score"))
    ways = [F.struct(F.col(f"{x}_doc").alias("doc"), F.col(f"{y}_doc").alias("other"), F.col(f"{x}_least").alias("least")) for x, y in ("ab", "ba")]
    kept = scores.select("code", F.explode(F.array(*ways)).alias("p"), "score").filter((F.col("score") >= F.col("p.least")) & (F.col("score") >= least)).select("code", "p.doc", "p.other", "score")
    order = [F.desc("score"), "other"]
    first = ranked(kept, ["code", "doc"], order, k).select("doc", "other", "score")  # where the pairs are made
    return ranked(first.repartition(parts, "doc").groupBy("doc", "other").agg(F.max("score").alias("score")), ["doc"], order, k)


def contained(titles: DataFrame, key: str, words: str, least: float) -> DataFrame:
    """a, b, share: pairs whose common words make ``least`` of the shorter's, a's words being no
    more than b's.

    A title of n words has one of its n - ceil(least * n) + 1 rarest words in common with any
    such partner, so only these are looked up among the others' words.
    """
    x = titles.select(F.col(key).alias("id"), F.array_distinct(words).alias("k")).filter(F.size("k") > 0)
    each = x.select("id", F.size("k").alias("n"), F.explode("k").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    ranks = each.join(df, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    short = ranks.select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("r")).select("a", "na", "r.word")
    met = short.join(each.select(F.col("id").alias("b"), F.col("n").alias("nb"), "word"), "word").filter("na < nb or (na = nb and a < b)").select("a", "b").distinct()
    both = met.join(x.select(F.col("id").alias("a"), F.col("k").alias("x")), "a").join(x.select(F.col("id").alias("b"), F.col("k").alias("y")), "b")
    share = F.size(F.array_intersect("x", "y")) / F.size("x")
    return both.select("a", "b", F.round(share, 6).alias("share")).filter(F.col("share") >= least)


def jaccard_top_k(left: DataFrame, right: DataFrame, key: str, terms: str, k: int, least: float) -> DataFrame:
    """key, match, score, rank: the right rows whose term sets are most alike, by an inverted index."""
    a = left.select(F.col(key), F.explode(F.array_distinct(terms)).alias("t"), F.size(F.array_distinct(terms)).alias("na"))
    b = right.select(F.col(key).alias("match"), F.explode(F.array_distinct(terms)).alias("t"), F.size(F.array_distinct(terms)).alias("nb"))
    both = a.join(b, "t").groupBy(key, "match", "na", "nb").agg(F.count("*").alias("both"))
    score = F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6)
    return ranked(both.withColumn("score", score).filter(F.col("score") >= least).select(key, "match", "score"), [key], [F.desc("score"), "match"], k)
