"""Classification by a table of weighted rules: one pass of each text for all rules.

A rule names a facet, a value, a weight and a phrase of words, whose last may end in ``*``.  All
phrases go into one automaton, so a text is read once whatever the number of rules; what comes out
is (key, field, rule, amount), and weights, caps, confidences and the choice of values are plain
columns.  Sentences that come before a text's first one about its own matter are background and
count half; the state that this needs is carried over one text's sentences.

The rules are collected, ``RULES`` of them at most; texts are never shuffled, only what they
match.  Null and empty fields match nothing; a text without matches gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import for_workers, in_parts, sizes

#: Rules an automaton is built of at most.
RULES = 100_000
#: Bytes of text that are taken out of an Arrow batch at a time.
TAKEN = 1 << 20
SENTENCE = re.compile(r"[.!?]+[ \n]+")
NOT_WORD = re.compile(r"[^a-z0-9]+")


def automaton(rules: list[tuple[int, str]]):
    """Phrases as `` word word `` (with a star, without the last space), each with its rules."""
    import ahocorasick

    found: dict[str, list[int]] = {}
    for rule, phrase in rules:
        body = NOT_WORD.sub(" ", phrase.lower().rstrip("*")).strip()
        if body:
            found.setdefault(f" {body}" if phrase.endswith("*") else f" {body} ", []).append(rule)
    made = ahocorasick.Automaton()
    for text, ids in found.items():
        made.add_word(text, ids)
    if found:
        made.make_automaton()
    return made if found else None


def sentence_weights(sentences: list[str], own: re.Pattern | None) -> list[float]:
    """1 for each sentence, a half for those before the first about the text's own matter, if
    that comes in the first half."""
    weights = [1.0] * len(sentences)
    if own is not None:
        first = next((k for k, s in enumerate(sentences) if own.search(s)), 0)
        if first <= max(1, len(sentences) // 2):
            weights[:first] = [0.5] * first
    return weights


def matches(docs: DataFrame, rules: DataFrame, key: str, fields: list[str], own: str | None = None) -> DataFrame:
    """(key, field, rule, n, amount): how often each rule of ``rules`` (rule, phrase) stands in each
    field, and the same weighed by sentence."""
    for_workers(docs.sparkSession)
    table = [(r.rule, r.phrase) for r in rules.select("rule", "phrase").filter("phrase is not null").limit(RULES + 1).collect()]
    if len(table) > RULES:
        raise ValueError(f"more than {RULES} rules")
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, mark = automaton(table), re.compile(own) if own else None
        for batch in (part for whole in batches for part in in_parts(whole, sum(sizes(whole.column(k + 1)) for k in range(len(fields))), TAKEN)):
            keys, names, ids, counts, amounts = [], [], [], [], []
            if made is not None:
                for k, field in enumerate(fields):
                    for row, text in enumerate(batch.column(k + 1).to_pylist()):
                        found: dict[int, list[float]] = {}
                        sentences = SENTENCE.split(text.lower()) if text else []
                        for sentence, weight in zip(sentences, sentence_weights(sentences, mark), strict=True):
                            for _, hit in made.iter(f" {NOT_WORD.sub(' ', sentence).strip()} "):
                                for rule in hit:
                                    at = found.setdefault(rule, [0, 0.0])
                                    at[0] += 1
                                    at[1] += weight
                        keys += [row] * len(found)
                        names += [field] * len(found)
                        ids += found
                        counts += [n for n, _ in found.values()]
                        amounts += [a for _, a in found.values()]
            taken = batch.column(0).take(pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(amounts, pa.float64())], ["key", "field", "rule", "n", "amount"])

    shape = f"key {kind}, field string, rule long, n long, amount double"
    return docs.select(F.col(key).alias("key"), *fields).mapInArrow(work, shape)


def repeated(amount: Column) -> Column:
    """What is said three times is a text's own; what is said once may be background."""
    return F.when(amount <= 1, amount).otherwise(F.least(F.lit(2.0), 1 + 0.5 * (amount - 1)))


def scores(found: DataFrame, rules: DataFrame, field_weights: dict[str, float], whole: list[str], cap: float = 6.0, scale: float = 2.5) -> DataFrame:
    """(key, facet, value, score, confidence, reasons): sums of field weight, rule weight and
    amount, capped by field; in the ``whole`` fields a match counts once.  Reasons are the three
    rules that give most."""
    weight = F.create_map(*[F.lit(x) for f, w in field_weights.items() for x in (f, float(w))])[F.col("field")]
    amount = F.when(F.col("field").isin(whole), F.lit(1.0)).otherwise(repeated(F.col("amount")))
    rated = found.join(rules.select("rule", "facet", "value", F.col("weight").alias("_w")), "rule").withColumn("part", weight * F.col("_w") * amount)
    by = rated.groupBy("key", "facet", "value", "field").agg(F.sum(F.col("part").cast("decimal(20,4)")).alias("part"), F.collect_list(F.struct((-F.col("part")).alias("by"), "rule")).alias("said"))
    each = by.groupBy("key", "facet", "value").agg(F.sum(F.least("part", F.lit(cap).cast("decimal(20,4)"))).cast("double").alias("score"), F.array_sort(F.flatten(F.collect_list("said"))).alias("said"))
    reasons = F.slice(F.array_distinct(F.transform("said", lambda s: s["rule"])), 1, 3)
    return each.select("key", "facet", "value", "score", F.round(1 - F.exp(-F.col("score") / scale), 6).alias("confidence"), reasons.alias("reasons"))


def decided(scored: DataFrame, single: list[str], least: float = 0.5, close: float = 0.8, exclusive: dict[str, str] | None = None) -> DataFrame:
    """(key, facet, value, confidence, rank, chosen, ambiguous).

    Of a ``single`` facet the best value is chosen; it is ambiguous if the next is ``close`` to it
    or if no value reaches ``least``.  Of others all values that reach ``least`` are chosen,
    ambiguous if none does.  An ``exclusive`` value of a facet is chosen only if it is the best, and
    then alone.
    """
    order = Window.partitionBy("key", "facet").orderBy(F.desc("confidence"), "value")
    whole = Window.partitionBy("key", "facet")
    rows = scored.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("confidence").over(order))
    first = F.col("rank") == 1
    best = F.max(F.when(first, F.col("confidence"))).over(whole)
    second = F.max(F.when(first, F.col("next"))).over(whole)
    top = F.max(F.when(first, F.col("value"))).over(whole)
    alone = F.lit(None).cast("string")
    for facet, value in (exclusive or {}).items():
        alone = F.when(F.col("facet") == facet, F.lit(value)).otherwise(alone)
    only = F.col("facet").isin(single) | F.coalesce(top == alone, F.lit(False))
    enough = F.col("confidence") >= least
    other = F.coalesce(F.col("value") == alone, F.lit(False))
    chosen = F.when(only, first & enough).otherwise(enough & ~other)
    unclear = F.when(F.col("facet").isin(single), (best < least) | (F.coalesce(second, F.lit(0.0)) >= close * best)).otherwise(best < least)
    return rows.select("key", "facet", "value", "confidence", "rank", chosen.alias("chosen"), unclear.alias("ambiguous"))


def margin(found: DataFrame, rules: DataFrame, toward: str, away: str, bias: float = 0.0) -> DataFrame:
    """(key, chance): a logistic of the weights of the rules of one value less those of another."""
    rated = found.join(rules.filter(F.col("value").isin(toward, away)), "rule")
    signed = F.when(F.col("value") == toward, F.col("weight")).otherwise(-F.col("weight")) * repeated(F.col("amount"))
    return rated.groupBy("key").agg(F.sum(signed.cast("decimal(20,4)")).cast("double").alias("_m")).select("key", F.round(1 / (1 + F.exp(-(F.col("_m") + F.lit(bias)))), 6).alias("chance"))


def overriding(rule_rows: DataFrame, model_rows: DataFrame, vocabulary: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Chosen values with those facets that rules left ambiguous settled by a model's answers
    (key, facet, said): answers are normalised, told by ``vocabulary`` (facet, alias, value), and
    unknown ones dropped.  (key, facet, value, confidence, by)"""
    alias = F.lower(F.trim(F.regexp_replace("said", r"[\s_-]+", " ")))
    known = model_rows.withColumn("alias", alias).join(vocabulary, ["facet", "alias"]).select("key", "facet", "value").distinct()
    open_ = rule_rows.filter("ambiguous").select("key", "facet").distinct()
    settled = known.join(open_, ["key", "facet"])
    kept = rule_rows.filter("chosen").join(settled.select("key", "facet").distinct(), ["key", "facet"], "left_anti")
    kept = kept.select("key", "facet", "value", "confidence", F.lit("rules").alias("by"))
    return kept.unionByName(settled.withColumns({"confidence": F.lit(confidence), "by": F.lit("model")}))

