"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Documents become pieces of at most ``limit`` tokens in one scan.  Pieces are dealt over
partitions of bounded size; each partition packs by best fit decreasing and computes a lower
bound of its bin count from dual-feasible functions.  A partition whose count exceeds its
bound hands the documents of its emptiest bins over, one bin more than the gap; they are dealt
anew over fewer partitions and packed again, until one partition is left.  Bins that stay are
final, so the rows that move shrink each round.

Defined results: null is an empty text (one piece, the end token); repeated rows are packed
each; pieces of the full length have a sequence each; equal lengths are taken in the order of
the rows; an empty table gives no rows; further columns of the pieces, whatever their names,
come back as they are, but for ``sequence_id`` and ``offset``, which are replaced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare, stash, trimmed
from .tokens import tokenizer_path, word_tokenizer

#: Pieces packed by a task.
GROUP = 4096
END = 1


def token_pieces(docs: DataFrame, limit: int = 4096, with_ids: bool = False, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text plus its end token."""
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), W.column(batch, "text")
            for a, b in W.slices(texts, 2 * W.SLICE):
                flat, first = tok.encode(texts.slice(a, b - a))
                flat = np.insert(flat, first[1:], END).astype("<u4")  # after each text's last id
                first = first + np.arange(len(first))
                size = np.diff(first)
                count = -(-size // limit)
                of = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * limit
                length = np.minimum(limit, size[of] - start)
                raw, lo = memoryview(flat.tobytes()), first[of] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(lo.tolist(), length.tolist(), strict=True)]
                cols = [keys.slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int64), np.cumsum(length))), pa.int32()), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """No packing into bins of ``limit`` has fewer bins: the best of two families of
    dual-feasible functions (thresholds, and roundings to k-ths; Fekete and Schepers)."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=limit + 1).astype(np.int64)
    x = np.arange(limit + 1)
    count, total = np.concatenate((n.cumsum(), [0])), np.concatenate(((n * x).cumsum(), [0]))
    best = -(-int(total[limit]) // limit)
    for t in {limit // 2, *np.flatnonzero(n[: limit // 2 + 1]).tolist()} - {0}:
        big = int(count[limit] - count[limit - t])
        middle = int(total[limit - t] - total[t - 1])
        best = max(best, big + -(-middle // limit))
    for k in range(1, 21):
        whole = (x * (k + 1)) % limit == 0
        value = np.where(whole, x * k, (x * (k + 1) // limit) * limit)  # in units of 1 / (k * limit)
        best = max(best, -(-int((n * value).sum()) // (k * limit)))
    return best


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: (bin, offset) of each item and each bin's free room."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    free: list[int] = []  # rooms that some bin has, ascending
    left: list[int] = []
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(free, n)
        if at < len(free):
            r = free[at]
            b = room[r].pop()
            if not room[r]:
                free.pop(at)
        else:
            r, b = limit, len(left)
            left.append(limit)
        where[k], offset[k] = b, limit - r
        left[b] = r - n
        if r > n:
            if not room[r - n]:
                insort(free, r - n)
            room[r - n].append(b)
    return where, offset, np.array(left, np.int64)


def _packer(limit: int, turn: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition and marks the bins whose documents it hands over."""
    def one(t: pa.Table) -> pa.Table:
        lengths, part = t["length"].to_numpy(), t["part"][0].as_py()
        where, offset, left = best_fit(lengths, limit)
        bound = lower_bound(lengths, limit)
        # one bin more than the gap: the last is seldom full
        loose = np.argsort(-left, kind="stable")[: len(left) - bound + 1]
        give = np.zeros(len(left), bool)
        give[loose[left[loose] > 0]] = not last
        # rounds and partitions have their own range of numbers, above those of full pieces
        ident = ((1 << 62) | (turn << 56) | (part << 24)) + where
        for name, x, kind in (("sequence_id", ident, pa.int64()), ("offset", offset, pa.int64()), ("open", give[where], pa.bool_()), ("bins", np.full(len(lengths), len(left)), pa.int64()), ("bound", np.full(len(lengths), bound), pa.int64())):
            t = t.append_column(name, pa.array(x, kind))
        return t

    return one


def pack(pieces: DataFrame, limit: int = 4096, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Rows of ``pieces`` (any columns beside ``length``) with sequence_id and offset, and the
    certificates (round, part, pieces, bins, bound)."""
    spark = pieces.sparkSession
    prepare(spark)
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row")
    at = stash(pieces.select(row, F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("id")))

    def told(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)], "sequence_id", "offset")

    n = at.count()
    done, said, turn = [], [], 0
    done.append(told(at.filter(F.col("length") >= limit).withColumns({"sequence_id": F.col("id"), "offset": F.lit(0).cast("long")})))
    at = at.filter(F.col("length") < limit)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema) + ", part int, sequence_id long, offset long, open boolean, bins long, bound long"
    n = max(1, n)
    while True:
        parts, last = -(-n // group), n <= group

        dealt = at.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)).cast("int"))
        made = stash(dealt.groupBy("part").applyInArrow(_packer(limit, turn, last), shape))
        said.append(made.groupBy("part").agg(F.count("*").alias("pieces"), F.max("bins").alias("bins"), F.max("bound").alias("bound")).select(F.lit(turn).alias("round"), "part", "pieces", "bins", "bound"))
        done.append(told(made.filter("not open")))
        if last:
            break
        at = made.filter("open").select("row", "length", "id")
        moved = at.count()
        if not moved:
            break
        n, turn = (moved if moved < n else min(n - 1, group)), turn + 1
    out, bounds = done[0], said[0]
    for x in done[1:]:
        out = out.unionByName(x)
    for x in said[1:]:
        bounds = bounds.unionByName(x)
    return out, bounds


def certified(packed: DataFrame, limit: int = 4096) -> tuple[int, int]:
    """(sequences used, lower bound of any packing) of all pieces, from a histogram of their lengths."""
    rows = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # ``limit`` rows at most
    lengths = np.repeat(np.array([r.length for r in rows], np.int64), [r.n for r in rows]) if rows else np.zeros(0, np.int64)
    return packed.filter("offset = 0").count(), lower_bound(lengths, limit)
