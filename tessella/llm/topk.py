"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to floor(scale * x).  A block of candidates is stored by attribute and
bit: one bitmap over the block's rows for each.  A query's score is the sum of its weights
times the attributes, so its set bits pick slices that carry-save adders add up, all rows of
the block at once.  The k-th value comes from the sum's slices, most significant first; rows
that the dropped low bits could still lift over it are the boundary and are scored exactly.

Queries and candidates meet block by block (a stated query set against all rows): a task
holds one block of each, whatever the table's size, makes the block's slices once, and gives k
rows for each query.  Blocks of both have one size, which sends the fewest rows for the work.

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with 0; rows with the query's own id are not candidates;
ties go to the smaller id; repeated rows are candidates each; an empty table gives no rows;
further columns, whatever their names, are ignored.  Scores must fit in a 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare

U = np.uint64
ROWS = QUERIES = 8192
#: Low bits that the index leaves to the exact step.
DROPPED = 2


class SlicedIndex:
    """Bit slices of an integer matrix (rows, attributes)."""

    def __init__(self, m: np.ndarray, dropped: int = DROPPED):
        self.m, self.n, self.dropped = m, len(m), dropped
        self.low = m.min(0)
        high = (m - self.low) >> dropped
        self.bits = max(1, int(high.max()).bit_length())
        words = -(-self.n // 64)
        full = np.zeros((words * 64, m.shape[1]), np.int64)
        full[: self.n] = high
        self.slices = np.stack([np.packbits(np.ascontiguousarray((full >> b & 1).astype(np.uint8).T), axis=1, bitorder="little").view(U) for b in range(self.bits)], 1)
        alive = np.zeros(words * 64, np.uint8)
        alive[: self.n] = 1
        self.alive = np.packbits(alive, bitorder="little").view(U)

    def _sum(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * (attribute, or its complement where q < 0)), least first."""
        size, wide = np.abs(q), int(np.abs(q).max()).bit_length()
        columns: dict[int, list[np.ndarray]] = {}
        sign = np.where(q < 0, U(0xFFFFFFFFFFFFFFFF), U(0))[:, None]
        for b in range(wide):
            take = np.flatnonzero(size >> b & 1)
            for s in range(self.bits) if len(take) else ():
                columns.setdefault(b + s, []).append(self.slices[take, s] ^ sign[take])
        out, w = [], 0
        while w <= max(columns, default=-1):
            col = np.concatenate(columns[w]) if w in columns else np.zeros((1, len(self.alive)), U)
            while len(col) > 1:
                if len(col) == 2:
                    total, carry = col[:1] ^ col[1:], col[:1] & col[1:]
                    rest = col[2:]
                else:
                    t = len(col) // 3
                    a, b, c = col[:t], col[t : 2 * t], col[2 * t : 3 * t]
                    half = a ^ b
                    total, carry, rest = half ^ c, (a & b) | (half & c), col[3 * t :]
                columns.setdefault(w + 1, []).append(carry)
                col = np.concatenate((total, rest)) if len(rest) else total
            out.append(col[0])
            w += 1
        return out

    def top(self, q: np.ndarray, k: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, the rows in ``but`` left out, and their exact scores."""
        alive = self.alive.copy()
        for r in but:
            alive[r >> 6] &= ~(U(1) << U(r & 63))
        slices = self._sum(q)
        left, at, value = k, alive, 0
        for i in range(len(slices) - 1, -1, -1):
            ones = at & slices[i]
            n = int(np.bitwise_count(ones).sum())
            if n >= left:
                at, value = ones, value | 1 << i
            else:
                left, at = left - n, at & ~slices[i]
        least = max(0, value - (int(np.abs(q).sum()) * ((1 << self.dropped) - 1) >> self.dropped) - 1)
        more, same = np.zeros_like(alive), alive
        if least.bit_length() > len(slices):
            same = more
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                same = same & slices[i]
            else:
                more = more | (same & slices[i])
                same = same & ~slices[i]
        rows = np.flatnonzero(np.unpackbits((more | same).view(np.uint8), bitorder="little"))
        return rows, self.m[rows] @ q


def quantised(column: str, scale: int) -> Column:
    """floor(scale * x) of every component; null where a component is null or not finite."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each row whose key is divisible by ``every``: its k best rows (query_id, rank, vec_id, score)."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(column, scale).alias("v")).filter("id is not null and v is not null")
    asked = F.col("id") % every == 0
    n, m = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks, groups = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))

    def spread(df: DataFrame, query: bool) -> DataFrame:
        block, group = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(groups))
        every_block, every_group = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (blocks, groups))
        out = df.select("id", "v", F.lit(query).alias("query"), (every_block if query else block).alias("block"), (group if query else every_group).alias("at"))
        return out.withColumns({c: F.col(c).cast("int") for c in ("block", "at")})

    def search(t: pa.Table) -> pa.Table:
        ids, asks = t["id"].to_numpy(), t["query"].to_numpy(zero_copy_only=False)
        v = t["v"].combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        m = np.zeros((len(ids), max(1, int(size.max(initial=0)))), np.int64)
        m[np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
        out: list[tuple] = []
        if not asks.all():
            index, own = SlicedIndex(m[~asks]), ids[~asks]
            order = np.argsort(own, kind="stable")
            done = set()
            for x, q in zip(ids[asks], m[asks], strict=True):
                if (int(x), q.tobytes()) in done:
                    continue
                done.add((int(x), q.tobytes()))
                a, b = np.searchsorted(own[order], (x, x + 1))
                hit, score = index.top(q, k, order[a:b])
                best = np.lexsort((own[hit], -score))[:k]
                out += [(int(x), int(own[hit[r]]), int(score[r])) for r in best]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    found = spread(rows, False).union(spread(rows.filter(asked), True)).groupBy("block", "at").applyInArrow(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
