"""Target-distribution importance resampling over hashed word n-grams.

Documents are weighed by how much likelier their features are in a target than in the corpus,
and a share of them is drawn with Gumbel noise, which is sampling without replacement in
proportion to the weights.

Identical texts are collapsed first, by grouping the full text: features and weight of a text are
computed once, its counts are multiplied by the number of its copies, and weights are joined back
to the documents by the text's digest before the noise, which depends on the document.  A text
with very many copies is one partly aggregated row in the grouping, and its copies carry a digest
only in the join, whose hot side adaptive execution may split.

The corpus counts come from all texts: each task adds up an array of ``buckets`` counts, and only
these meet.  The gains, one number a bucket, are what the driver sees.  Ranks need no order over
all rows: scores are whole numbers within some ten thousands of each other, because the noise and
the logarithms of counts are, so a histogram of scores gives every score its first rank, and rows
of one score are numbered among themselves.

Defined results: null and blank texts have no features, weight 0, and are never drawn; very long
texts are read whole, a stretch at a time; ties of a score go to the smaller key, nulls last, then to fewer words;
repeated rows are drawn one by one with following ranks; an empty target or table gives gains that
are equal or no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, stash, trimmed
from .words import column

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text whose words are held at a time.
STRETCH = 1 << 20


def features(text: str, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each stretch of a text its number of words and the buckets of all runs of one or two
    words that end in it: a run of two continues the checksum of its first word."""
    data = text.encode().lower()  # bytes: A-Z only
    at, last = 0, []
    while at < len(data):
        cut = GAP.search(data, at + STRETCH)
        to = cut.start() if cut else len(data)
        words = WORD.findall(data, at, to)
        at = to
        if words:
            ones = list(map(crc32, words))
            before = last + ones[:-1]
            twos = map(crc32, words[len(words) - len(before) :], map(crc32, repeat(b" "), before))
            yield len(words), np.fromiter(chain(ones, twos), np.int64, len(ones) + len(before)) % buckets
            last = ones[-1:]


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text, copies in zip(column(batch, "text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, found in features(text, buckets):
                    total += np.bincount(found, minlength=buckets) * copies
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over ``texts`` (text, copies): each task gives at most a row a bucket."""
    return texts.select("text", "copies").mapInArrow(trimmed(_count(buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain in thousandths, from counts (bucket, n): a row a bucket comes to the driver."""
    rows = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    out = np.zeros((buckets, 2))
    for r in rows.collect():
        out[r.bucket] = r.s, r.t
    s, t = out[:, 0], out[:, 1]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(column(batch, "text").to_pylist()):
                for words, found in features(text, len(gain)):
                    told[k] += words, len(found), gain[found].sum()
            mean = told[:, 2] // np.maximum(told[:, 1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x) for x in (told[:, 0], told[:, 1], mean))], ["digest", "n_words", "n_features", "weight"])

    return run


def noise(key: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths from a digest of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` (key, score, ...) with ``rank``: 1, 2, ... by score, then key, for ``percent`` of
    the eligible rows, null for the rest."""
    sizes = scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n"))  # a row a score: bounded by the noise
    best = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above, most = F.sum("n").over(best) - F.col("n"), F.floor(F.lit(percent) * F.sum("n").over(Window.partitionBy()) / 100)
    placed = scored.join(F.broadcast(sizes.select("score", above.alias("_above"), most.alias("_most"))), "score", "left")
    open_ = F.coalesce(eligible & (F.col("_above") < F.col("_most")), F.lit(False))
    rank = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last(), *scored.columns))
    among = placed.filter(open_).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank")))
    return among.unionByName(placed.filter(~open_).withColumn("rank", F.lit(None).cast("long"))).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10000, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_features, weight, score and rank (null: not drawn)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = stash(rows.groupBy("text").agg(F.count("*").alias("copies")))
    wanted = target.select(F.col(target_text).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(wanted, buckets), buckets)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    weighed = texts.select("text", digest).mapInArrow(trimmed(_weigh(gain)), "digest binary, n_words long, n_features long, weight long")
    scored = stash(rows.select("key", digest).join(weighed, "digest").select("key", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("key"), seed)).alias("score")))
    forget(texts)
    return ranked(scored, F.col("n_words") >= least_words, percent).select("key", "n_features", "weight", "score", "rank")
