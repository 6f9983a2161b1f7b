"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

SuperMinHash (Ertl, 2017): each element visits the signature's positions in its own random
order and offers (rank + uniform) there; a position keeps the least offer.  The ranks of an
element are a permutation, hence negatively correlated between positions, which lowers the
estimate's variance, and a text is done once every position has an offer, which large sets
reach after one or two ranks.

Plan: signatures in one scan of the texts (no shuffle of texts); equal texts become one node;
the members of an equal band key meet one of them, a star, and these pairs are verified on full
shingle sets.  Verified links give components, and a band key whose members are all in one
component is done: further links would change nothing.  In the others, the members outside the
commonest component are compared with all members by blocks of bounded size, so a group of any
size is spread over tasks and no candidate is skipped; where many keys hold the same texts, these
are compared once instead of key by key.  A large group of copies costs its size; only members
that no verified link joins are compared each with each.
Two texts over the threshold miss each other only when all bands differ, with probability
(1 - 0.8^5)^32 = 3e-6 at a similarity of exactly 0.8, and then only if no chain of other texts
joins them.

Defined results: null or blank text has an empty set, links with nothing and is kept; so is a
row without a key; a repeated row gets a result row each; an empty table gives none; further
columns, whatever their names, are ignored (``drop_near_duplicates`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, forget, prepare, stash, trimmed

U = np.uint64
#: Members of a band key compared at a time with as many others.
BLOCK = 64


def super_minhash(h: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) uint32 of sets of hashes; rows of empty sets hold the largest value."""
    sig = np.full((n, m), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    perm = None
    for j in range(m):
        if not len(h):
            break
        r = W.mix(h + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        if perm is None:
            place = k
        else:
            row = np.arange(len(h))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[row, j] = place
        np.minimum.at(flat, doc * m + place, (np.uint32(j) << np.uint32(24)) | (r >> U(40)).astype(np.uint32))
        open_ = (sig == 0xFFFFFFFF).any(1)[doc]
        if perm is None:
            h, doc, k = h[open_], doc[open_], k[open_]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(h), 1))
            row = np.arange(len(h))
            perm[row, k] = 0
            perm[:, 0] = k
        elif not open_.all():
            h, doc, perm = h[open_], doc[open_], perm[open_]
    return sig


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(len(sig), bands, -1).astype(U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(W.BASE), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        key = W.mix(key * U(W.BASE) + rows[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(doc, node, n_shingles, bands): node is the digest of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.column(batch, "text")
            for a, b in W.slices(texts):
                words = W.split(texts.slice(a, b - a))
                h, doc = W.distinct(*W.shingles(words, size))
                count = np.bincount(doc, minlength=b - a)
                keys = _bands(super_minhash(W.mix(h), doc, b - a, bands * rows), bands)
                have = count > 0
                offsets = np.concatenate(([0], np.cumsum(have * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count), pa.ListArray.from_arrays(offsets, keys[have].reshape(-1))],
                    ["doc", "node", "n_shingles", "bands"],
                )

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows_in = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.unhex(F.md5(body)).alias("node"), body.alias("text"))
    return rows_in.mapInArrow(trimmed(run), "doc long, node binary, n_shingles long, bands array<long>")


def _links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (left, right) with enough in common, by one product of
    membership matrices over the hashes that occur twice or more."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    ident = np.cumsum(new) - 1
    often = np.bincount(ident)[ident] > 1
    _, ident = np.unique(ident[often], return_inverse=True)
    owner = owner[often]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    top = int(ident.max()) + 1 if len(ident) else 0
    for a in range(0, top, 8192):
        at = (ident >= a) & (ident < a + 8192)
        x = np.zeros((len(sets), min(8192, top - a)), np.float32)
        x[owner[at], ident[at] - a] = 1
        inter += x @ x.T
    inter = np.rint(inter).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    hit = (100 * inter >= percent * union) & (inter > 0) & left[:, None] & right[None, :]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(hit), strict=True):
        x, y = find(int(a)), find(int(b))
        if x != y:
            parent[x] = y
            out.append((int(a), int(b)))
    return out


def _links(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rows (a, b, x, y) whose texts x and y have enough in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(2), batch.column(3)]
            cut = sorted({0, batch.num_rows, *(b for t in texts for _, b in W.slices(t))})
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                sets = [W.distinct(*W.shingles(W.split(t.slice(a, b - a)), size)) for t in texts]
                n = [np.bincount(doc, minlength=b - a) for _, doc in sets]
                h, doc = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                twice = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                both = np.bincount(doc[1:][twice], minlength=b - a)
                ok = pa.array((both > 0) & (100 * both >= percent * (n[0] + n[1] - both)))
                yield batch.select(["a", "b"]).slice(a, b - a).filter(ok)

    return pairs.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a binary, b binary")


def _verified(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among rows (g, i, j, chunk, node, text), block by block."""
    def block(rows: list) -> list[tuple[bytes, bytes]]:
        table = pa.Table.from_batches(rows)
        node = table["node"].to_pylist()
        seen = {}
        for k, x in enumerate(node):
            seen.setdefault(x, k)  # a repeated row brings its text twice
        take = list(seen.values())
        if len(take) < 2:
            return []
        table = table.take(take).combine_chunks()
        node, chunk = [node[k] for k in take], table["chunk"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        words = W.split(table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"])
        h, doc = W.distinct(*W.shingles(words, size))
        edge = np.searchsorted(doc, np.arange(len(node) + 1))
        found = _links_of([h[edge[k] : edge[k + 1]] for k in range(len(node))], chunk == i, chunk == j, percent)
        return [(node[a], node[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None
        out: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            lo = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[lo]:
                    if at is not None and keys[lo] != at:
                        out += block(held)
                        held = []
                    at = keys[lo]
                    held.append(batch.slice(lo, k - lo))
                    lo = k
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])
                out = []
        if held:
            out += block(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.select("g", "i", "j", "chunk", "node", "text").mapInArrow(trimmed(run), "a binary, b binary")


def _grouped(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, node (the digest of a text that has words), n_shingles, component_id."""
    prepare(docs.sparkSession)
    sig = stash(signatures(docs, size, bands, rows, key, text))
    known = sig.filter("n_shingles > 0 and doc is not null")
    nodes = stash(known.groupBy("node").agg(F.min("doc").alias("doc")))
    buckets = stash(known.join(nodes, ["node", "doc"], "left_semi").dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket")))
    sizes = stash(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    dealt = stash(buckets.join(sizes, "bucket"))
    forget(buckets, sizes)
    # the member that shares keys with the most others is likeliest to be what the others are copies of
    rank = dealt.groupBy("node").agg(F.sum("n").alias("rank"))
    met = stash(dealt.select("node", "bucket").join(rank, "node"))
    hubs = stash(met.groupBy("bucket").agg(F.max_by("node", F.struct("rank", "node")).alias("hub")))
    shared = stash(met.join(hubs, "bucket"))
    forget(dealt, met, hubs)
    star = stash(shared.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    needed = shared.select("node").distinct().join(nodes, "node")
    body = F.col(f"`{text}`").cast("string")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), body.alias("text")).filter("text is not null").withColumn("node", F.unhex(F.md5("text")))
    texts = stash(texts.join(needed, ["doc", "node"], "left_semi").select("node", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return stash(_links(both, size, percent))

    links = verified(star)
    roots = stash(shared.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")))

    def opened(members: DataFrame) -> DataFrame:
        """Members (g, node, root) of the groups that several components hold, with whether they
        are outside the commonest, and how many blocks those inside and outside make."""
        held = members.groupBy("g", "root").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
        sizes = held.select("g", F.col("main.root").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("others"))
        return members.join(stash(sizes), "g").withColumn("apart", F.col("root") != F.col("main"))

    at = stash(opened(shared.select(F.col("bucket").alias("g"), "node").join(roots, "node")))
    # Keys of one group of texts repeat its pairs: where that costs more, the group is compared once.
    first = at.groupBy("g").agg(F.min("node").alias("b"), F.sum(F.when(F.col("apart"), F.col("others") + F.col("mains")).otherwise(F.col("others"))).alias("cost"))
    first = stash(first)
    groups = stash(components(at.join(first, "g").filter("node != b").select(F.col("node").alias("a"), "b").distinct()))
    whole = groups.groupBy("root").agg((F.count("*") * F.ceil(F.count("*") / BLOCK)).alias("once"))
    apiece = first.join(groups, F.col("b") == F.col("node")).groupBy("root").agg(F.sum("cost").alias("cost"))
    chosen = stash(whole.join(apiece, "root").select(F.col("root").alias("group"), (F.col("once") < F.col("cost")).alias("together")))
    placed = stash(groups.select("node", F.col("root").alias("group")).join(chosen, "group").join(roots, "node"))
    together = opened(placed.filter("together").select(F.xxhash64("group").alias("g"), "node", "root"))
    alone = at.join(placed.filter("not together").select("node"), "node", "left_semi")
    members_kept = members = stash(together.select("g", "node", "apart", "mains", "others").union(alone.select("g", "node", "apart", "mains", "others")))
    chunk = F.pmod(F.xxhash64("node", "g"), F.when(F.col("apart"), F.col("others")).otherwise(F.col("mains"))).cast("int")
    members = members.withColumn("chunk", F.when(F.col("apart"), chunk).otherwise(-1 - chunk))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    among = F.transform(upto("others"), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    across = F.transform(upto("mains"), lambda m: F.struct(F.col("chunk").alias("i"), (-1 - m).alias("j")))
    main = F.transform(upto("others"), lambda o: F.struct(o.alias("i"), F.col("chunk").alias("j")))
    dealt = members.select("g", "node", "chunk", F.explode(F.when(F.col("apart"), F.concat(among, across)).otherwise(main)).alias("at")).select("g", "at.i", "at.j", "chunk", "node")
    more = _verified(dealt.join(texts, "node"), size, percent).join(roots.select(F.col("node").alias("a"), F.col("root").alias("u")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("v")), "b")
    up = components(more.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
    forget(texts, first, groups, chosen, placed, members_kept, at, star, links)
    joined = stash(roots.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    least = joined.join(nodes, "node").groupBy("root").agg(F.min("doc").alias("component_id"))
    # written once, so that the join with all copies meets a plain table and its hot keys can be split
    classes = stash(nodes.join(joined.join(least, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "doc").alias("component_id")))
    # a blank text is linked with nothing, not even with its copies
    out = sig.select("doc", F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("node")).alias("node"), "n_shingles").join(classes, "node", "left")
    return out.select("doc", "node", "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * |A & B| >= percent * |A | B| over their sets of
    ``size``-word shingles; component_id is the least key reachable.
    """
    out = _grouped(docs, size, percent, bands, rows, key, text)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the least key.  Of rows
    alike in key and text one stays; rows without a key or without words stay."""
    told = _grouped(docs, size, percent, key=key, text=text).filter("node is not null").select("doc", "node", (F.col("doc") != F.col("component_id")).alias("gone")).distinct()
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    named = docs.select(row, F.col(f"`{key}`").cast("long").alias("doc"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))).alias("node"))
    left = named.join(told, ["doc", "node"], "left").filter("gone is null or not gone")
    # rows without a key or words are told apart by a number
    alone = F.when(F.col("gone").isNull(), F.monotonically_increasing_id())
    kept = left.withColumn("alone", alone).groupBy("doc", "node", "alone").agg(F.first("row").alias("row"))
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
