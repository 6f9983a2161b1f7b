"""A search index of postings: queries read the files of their terms, never the texts.

Documents get a stable row number when they first come.  For each term and block of 2,048 row
numbers there is one posting (a few, where a block was read in parts): how many documents, the
greatest count of the term by column and the least length in the block, and, packed
by numpy, each document's place in the block, length, counts by column and places in the text.  The empty
term's posting holds all documents with their lengths.  Postings are dealt to folders, lots, by
ranges of terms, so a query prunes all lots but those of its terms, and a prefix is a range too;
within a lot they are sorted, so a reader skips most of a file.  A term that is in most documents
is dealt over several files by its blocks.

The ranking is BM25 with a weight for each column.  A block's greatest counts and least length
bound its scores: a first look at the best bounds gives a score that the top ``k`` must reach, and
only blocks that can reach it are scored, so the result is that of scoring everything.

``refresh`` brings an index to a new table of documents: those whose digest changed and new ones
become a segment, what they replace and what is gone becomes a list of dead entries, and one
rename switches to the new state.  ``compact`` makes one segment of all.

Nulls are empty columns; keys must not repeat; an empty table gives an index without terms.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Commits, Files, for_workers, fresh, in_parts, sizes, written

#: Row numbers of a block, as a shift (16 at most).
BLOCK = 11
#: Bytes of text whose places are sorted at a time.
CHUNK = 1 << 23
#: Bytes of packed postings that are opened at a time; numpy needs some hundred times as many.
OPENED = 1 << 19
#: Bytes of text that are taken out of an Arrow batch at a time.
TAKEN = 1 << 20
#: Bytes of a file's groups of rows, which bounds of terms and blocks let a reader skip.
ROWS = 1 << 22
#: Documents, about, whose terms set the lots' bounds; any bounds are right, these are even ones.
SAMPLE = 2000
#: Row numbers or blocks that are named in a filter at most; beyond, a join meets them.
NAMED = 1000
TOKEN = re.compile(rb"[0-9a-z]+")
HIT = "term string, rowid bigint, len int, tf array<int>, at array<int>"


def _shape(columns: int) -> str:
    most = "".join(f"most{c} int, " for c in range(columns))
    return f"lot int, term string, block bigint, n int, least int, {most}body binary"


def _names(shape: str) -> list[str]:
    return [f.split()[0] for f in shape.split(", ")]


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers as seven bits a byte, the least first, one binary for each stretch between ``cuts``."""
    v = values.view(np.uint32) if values.dtype == np.int32 else values.astype(np.uint64)
    kind = v.dtype.type
    width = np.ones(len(v), np.uint8)
    for k in range(1, 5 if kind is np.uint32 else 6):
        width += v >= kind(1 << (7 * k))
    upto = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    out = np.zeros(upto[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        more = width > k
        out[upto[:-1][more] + k] = ((v[more] >> kind(7 * k)) & kind(127)) | (kind(128) * (width[more] > k + 1))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(upto[cuts].astype(np.int32)), pa.py_buffer(out)])


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(raw < 128) + 1))
    if len(first) == 1:
        return np.zeros(0, np.int64)
    shift = (np.arange(len(raw)) - np.repeat(first[:-1], np.diff(first))) * 7
    return np.add.reduceat((raw & 127) << shift, first[:-1])


def _body(ids: np.ndarray, lens: np.ndarray, tf: np.ndarray, place: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """For each stretch of entries between ``cuts``: all places in the block, lengths, counts by
    column, and then the places in the texts, each less the one before of its entry."""
    columns, m = tf.shape[1], np.diff(cuts)
    step = np.diff(place, prepend=0)
    begin = ends[:-1][np.diff(ends) > 0]
    step[begin] = place[begin]
    p = np.diff(ends[cuts])
    base = np.concatenate(([0], np.cumsum(m * (2 + columns) + p)))
    flat = np.zeros(base[-1], np.int32)
    row = np.repeat(np.arange(len(m)), m)
    at = base[row] + np.arange(len(ids)) - cuts[row]
    flat[at], flat[at + m[row]] = ids, lens
    for c in range(columns):
        flat[at + (2 + c) * m[row]] = tf[:, c]
    own = np.repeat(np.arange(len(m)), p)
    flat[base[own] + (2 + columns) * m[own] + np.arange(len(place)) - ends[cuts][own]] = step
    return packed(flat, base)


def _lists(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.int32()))


def _postings(rowids: list[int], texts: list[list[bytes]], columns: int, bounds: list[str], shift: int) -> pa.RecordBatch:
    """The postings of some documents, each a list of column texts in lower case."""
    known: defaultdict = defaultdict(itertools.count().__next__)
    known[b""]
    ids = np.array(rowids, np.int64)
    term, counts = [], np.zeros((len(texts), columns), np.int64)
    for k, fields in enumerate(texts):
        term.append(np.zeros(1, np.int32))  # the empty term stands once in each document
        for c, data in enumerate(fields):
            words = TOKEN.findall(data)
            term.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            counts[k, c] = len(words)
    term = np.concatenate(term)
    size = counts.sum(1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size + 1)
    column = np.repeat(np.tile(np.arange(-1, columns, dtype=np.int32), len(texts)), np.insert(counts, 0, 1, 1).ravel())
    # places go on over the columns with a gap, so that no phrase goes from one into the next
    place = np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(size + 1) - size - 1).astype(np.int32), size + 1) + column
    order = np.lexsort(((ids >> shift)[doc], term)).astype(np.int32)  # stable: documents and places stay in order
    term, doc, place, column = term[order], doc[order], place[order], column[order]
    entry = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))))
    e_term, e_doc = term[entry], doc[entry]
    e_block = ids[e_doc] >> shift
    first = np.flatnonzero(np.concatenate(([True], (e_term[1:] != e_term[:-1]) | (e_block[1:] != e_block[:-1]))))
    tf = np.stack([np.add.reduceat((column == c).astype(np.int32), entry) for c in range(columns)], 1)
    names = [b.decode() for b in known]
    cuts, ends = np.append(first, len(entry)), np.append(entry, len(term))
    own = [names[t] for t in e_term[first].tolist()]
    lots = np.searchsorted(np.array(bounds, object), np.array(own, object), "right") if bounds else np.zeros(len(own), np.int64)
    said = e_term != 0  # the empty term has no places
    ends = np.concatenate(([0], np.cumsum(np.diff(ends) * said)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lots, pa.int32()),
            pa.array(own, pa.string()),
            pa.array(e_block[first]),
            pa.array(np.diff(cuts), pa.int32()),
            pa.array(np.minimum.reduceat(size[e_doc], first), pa.int32()),
            *[pa.array(np.maximum.reduceat(tf[:, c], first), pa.int32()) for c in range(columns)],
            _body(ids[e_doc] & ((1 << shift) - 1), size[e_doc], tf, place[term != 0], ends, cuts),
        ],
        _names(_shape(columns)),
    )


def postings(rows: DataFrame, columns: list[str], bounds: list[str], shift: int = BLOCK) -> DataFrame:
    """Postings of ``rows`` (rowid, the columns); a term may have several rows for one block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            size = sum(sizes(batch.column(k + 1)) for k in range(len(columns)))
            for part in in_parts(batch, size, TAKEN):
                for rowid, *fields in zip(*(part.column(k).to_pylist() for k in range(len(columns) + 1)), strict=True):
                    ids.append(rowid)
                    texts.append([(x or "").lower().encode() for x in fields])
                    held += sum(map(len, texts[-1]))
                    if held >= CHUNK or len(ids) >= 1 << shift:
                        yield _postings(ids, texts, len(columns), bounds, shift)
                        ids, texts, held = [], [], 0
                        pa.default_memory_pool().release_unused()
        if ids:
            yield _postings(ids, texts, len(columns), bounds, shift)

    return rows.select("rowid", *columns).mapInArrow(work, _shape(len(columns)))


def _opened(bodies: list[bytes], m: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of some postings of ``m`` entries each: the posting, place in the block, length,
    counts by column, where places begin and places."""
    data = b"".join(bodies)
    flat = unpacked(data)
    said = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) < 128)))
    base = said[np.concatenate(([0], np.cumsum([len(x) for x in bodies])))]
    row = np.repeat(np.arange(len(m)), m)
    at = base[row] + np.arange(len(row)) - (np.cumsum(m) - m)[row]
    step = m[row]
    ids, lens = flat[at], flat[at + step]
    tf = np.stack([flat[at + (2 + c) * step] for c in range(columns)], 1)
    ends = np.concatenate(([0], np.cumsum(tf.sum(1))))
    p = np.diff(base) - (2 + columns) * m
    own = np.repeat(np.arange(len(m)), p)
    run = np.concatenate(([0], np.cumsum(flat[base[own] + (2 + columns) * m[own] + np.arange(len(own)) - (np.cumsum(p) - p)[own]])))
    return row, ids, lens, tf, ends, run[1:] - np.repeat(run[ends[:-1]], np.diff(ends))


def _entries(columns: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, sizes(batch.column("body")), OPENED):
                m, block = part.column("n").to_numpy().astype(np.int64), part.column("block").to_numpy()
                row, ids, lens, tf, ends, at = _opened(part.column("body").to_pylist(), m, columns)
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("term").take(pa.array(row)), pa.array(ids + (block[row] << shift)), pa.array(lens, pa.int32()), _lists(tf), places], _names(HIT))

    return run


def _without_dead(columns: int, shift: int, bounds: list[str]):
    """Postings in their lots by ``bounds``, less the places in the block whose bits are set in
    their ``dead`` column, without those left empty."""
    names = _names(_shape(columns))
    cuts = np.array(bounds, object)

    def lots(terms: pa.Array) -> pa.Array:
        own = np.array(terms.to_pylist(), object)
        return pa.array(np.searchsorted(cuts, own, "right") if bounds else np.zeros(len(own), np.int64), pa.int32())

    def left(part: pa.RecordBatch) -> pa.RecordBatch:
        m = part.column("n").to_numpy().astype(np.int64)
        row, ids, lens, tf, ends, at = _opened(part.column("body").to_pylist(), m, columns)
        bits = np.frombuffer(b"".join(part.column("dead").to_pylist()), np.uint8).reshape(len(m), -1)
        live = (bits[row, ids >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 0
        n, places = np.bincount(row[live], minlength=len(m)), np.diff(ends)
        kept, n = np.flatnonzero(n), n[n > 0]
        if not len(kept):
            return part.slice(0, 0).select(names)
        to, lens, tf = np.concatenate(([0], np.cumsum(n))), lens[live], tf[live]
        body = _body(ids[live], lens, tf, at[np.repeat(live, places)], np.concatenate(([0], np.cumsum(places[live]))), to)
        term, block = part.column("term").take(pa.array(kept)), part.column("block").take(pa.array(kept))
        most = [pa.array(np.maximum.reduceat(tf[:, c], to[:-1]), pa.int32()) for c in range(columns)]
        return pa.RecordBatch.from_arrays([part.column("lot").take(pa.array(kept)), term, block, pa.array(n, pa.int32()), pa.array(np.minimum.reduceat(lens, to[:-1]), pa.int32()), *most, body], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("lot"), "lot", lots(batch.column("term")))
            none = pc.is_null(batch.column("dead"))
            yield batch.filter(none).select(names)
            some = batch.filter(pc.invert(none))
            for part in in_parts(some, sizes(some.column("body")), OPENED):
                yield left(part)

    return run


def _lots(documents: int) -> int:
    """Lots for the postings of so many documents."""
    return min(4096, max(8, documents // 20_000))


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda x: x - back)


def _meeting(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``keys``: few keys are named in a filter that
    reaches the files, many are joined."""
    few = [r[0] for r in keys.select(column).distinct().limit(NAMED + 1).collect()]
    return df.filter(F.col(column).isin(few)) if len(few) <= NAMED else df.join(keys.select(column).distinct(), column, "left_semi")


class Index:
    """An index in a folder; ``refresh`` and ``compact`` write it, the rest reads it."""

    def __init__(self, spark: SparkSession, path: str, shift: int = BLOCK):
        for_workers(spark)
        self.spark, self.path, self._commits = spark, path, Commits(spark, path)
        self.number, self.state = self._commits.last()
        self.shift = self.state.get("shift", shift)
        if self.shift > 15:
            raise ValueError("a block's dead entries are a bitmap of 32,768 bits at most")

    @property
    def _posting(self) -> str:
        return _shape(len(self.state["columns"]))

    # -- writing

    def _bounds(self, rows: DataFrame, n: int, columns: list[str], lots: int) -> list[str]:
        """Terms that part the postings of a sample evenly."""
        found = postings(rows.sample(min(1.0, SAMPLE / max(n, 1)), seed=1), columns, [], self.shift).groupBy("term").agg(F.sum(F.length("body") + 64).alias("w"))
        within = sorted((r.term, r.w) for r in found.filter(F.col("w") > 200).collect())  # terms of a bounded sample
        total, cuts, at = sum(w for _, w in within), [], 0
        for term, w in within:
            if at + w >= (len(cuts) + 1) * total / lots and len(cuts) < lots - 1:
                cuts.append(term)
            at += w
        return cuts

    def _deal(self, found: DataFrame, lots: int) -> str:
        """Write postings by lot; a lot's blocks go to up to eight files, so no term is one task."""
        folder = fresh(self.spark, "postings")
        dealt = found.repartition(max(lots, 12), "lot", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("lot", "term", "block")
        dealt.write.partitionBy("lot").option("parquet.block.size", ROWS).option("compression", "zstd").parquet(folder)
        return folder

    def refresh(self, docs: DataFrame, key: str, columns: list[str], keep: list[str] | None = None, lots: int | None = None) -> dict[str, int]:
        """Bring the index to ``docs``; returns how many documents were new, changed and gone."""
        keep, first, number = keep or [], not self.state, self.number + 1
        if not first and (self.state["key"], self.state["columns"], self.state["keep"]) != (key, columns, keep):
            raise ValueError("the index was made of other columns")
        state = dict(self.state) if self.state else {"key": key, "columns": columns, "keep": keep, "segments": [], "dead": None, "shift": self.shift}
        told = F.concat(*[F.concat(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")), F.lit("\x1f")) for c in (*columns, *keep)])
        rows = docs.select(key, *dict.fromkeys([*columns, *keep]), F.sha2(told, 256).alias("_digest"))
        if first:
            changed, top = rows.withColumn("_was", F.lit(None).cast("long")), 0
        else:
            known = self.documents()
            was = known.select(F.col(key).alias("_k"), F.col("rowid").alias("_was"), F.col("_digest").alias("_old"))
            changed = rows.join(was, F.col(key) == F.col("_k"), "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("_digest"))).drop("_k", "_old")
            top = ((known.agg(F.max("rowid")).first()[0] or 0) >> 33) + 1
        folder = fresh(self.spark, "staged")
        staged = written(changed.withColumn("rowid", F.coalesce("_was", F.monotonically_increasing_id() + F.lit(top << 33))), folder)
        made = staged.select("rowid", key, *keep, "_digest", F.lit(number).alias("_segment"))
        new, other = staged.agg(F.count_if(F.col("_was").isNull()), F.count_if(F.col("_was").isNotNull())).first()
        counts = {"new": new, "changed": other, "gone": 0}
        if not first:
            replaced = staged.select("rowid")
            gone = known.join(rows.select(key), key, "left_anti")
            counts["gone"] = gone.count()
            ended = written(gone.select("rowid", "_segment").union(known.join(replaced, "rowid", "left_semi").select("rowid", "_segment")))
            made = made.unionByName(known.join(ended.select("rowid"), "rowid", "left_anti"))
            dead = ended.union(self.spark.read.parquet(state["dead"])) if state["dead"] else ended
            state["dead"] = fresh(self.spark, "dead")
            dead.write.parquet(state["dead"])
        state["documents"] = fresh(self.spark, "documents")
        made.repartitionByRange("rowid").sortWithinPartitions("rowid").write.parquet(state["documents"])
        n = lots or _lots(new + other)
        cuts = self._bounds(staged, new + other, columns, n)
        segment = {"number": number, "bounds": cuts, "folder": self._deal(postings(staged, columns, cuts, self.shift), n)}
        self._commit(state | {"segments": [*state["segments"], segment]}, number)
        Files(self.spark).delete(folder)
        return counts

    def compact(self) -> None:
        """One segment of all, without dead entries, in the first segment's lots."""
        number, state = self.number + 1, dict(self.state)
        bounds = state["segments"][0]["bounds"]
        rows = reduce(DataFrame.union, [self._folder(s).withColumn("segment", F.lit(s["number"])) for s in state["segments"]])
        none = F.lit(None).cast("binary").alias("dead")
        if state["dead"]:
            place = F.col("rowid").bitwiseAND((1 << self.shift) - 1)
            bits = F.substring(F.bitmap_construct_agg(place), 1, max(1, (1 << self.shift) // 8))  # a bit a row of the block
            rows = rows.join(self._dead().groupBy(F.shiftright("rowid", self.shift).alias("block"), "segment").agg(bits.alias("dead")), ["block", "segment"], "left")
            none = "dead"
        rows = rows.select(*_names(self._posting), none).mapInArrow(_without_dead(len(state["columns"]), self.shift, bounds), self._posting)
        folder = self._deal(rows, len(bounds) + 1)
        at = fresh(self.spark, "documents")
        self.documents().withColumn("_segment", F.lit(number)).repartitionByRange("rowid").sortWithinPartitions("rowid").write.parquet(at)
        self._commit(state | {"segments": [{"number": number, "bounds": bounds, "folder": folder}], "dead": None, "documents": at}, number)

    def _commit(self, state: dict, number: int) -> None:
        self.state = state
        n, total = self.hits([""]).agg(F.count("*"), F.sum("len")).first() if state["segments"] else (0, 0)
        self.state |= {"n": n, "mean": (total or 0) / n if n else 0.0}
        self._commits.commit(number, self.state)
        self.number = number

    # -- reading

    def documents(self) -> DataFrame:
        """rowid, key, the kept columns, _digest and _segment of the documents there are."""
        return self.spark.read.parquet(self.state["documents"])

    def _dead(self) -> DataFrame:
        return self.spark.read.parquet(self.state["dead"]).select("rowid", F.col("_segment").alias("segment"))

    def _folder(self, segment: dict, lots: list[int] | None = None) -> DataFrame:
        at = [segment["folder"]] if lots is None else [f"{segment['folder']}/lot={n}" for n in lots]
        there = set(Files(self.spark).names(segment["folder"]))
        at = [p for p in at if lots is None or p.rpartition("/")[2] in there]
        if not at or not any(n.startswith("lot=") for n in there):
            return self.spark.createDataFrame([], self._posting)
        return self.spark.read.schema(self._posting).option("basePath", segment["folder"]).parquet(*at)

    def of(self, terms: list[str], prefix: bool = False) -> DataFrame:
        """The postings of terms, or of all terms with a prefix, from the lots that can hold them."""
        out = []
        for s in self.state["segments"]:
            low = [int(np.searchsorted(s["bounds"], t, "right")) if s["bounds"] else 0 for t in terms]
            high = [int(np.searchsorted(s["bounds"], t + "￿", "right")) if s["bounds"] and prefix else a for t, a in zip(terms, low, strict=True)]
            rows = self._folder(s, sorted({k for a, b in zip(low, high, strict=True) for k in range(a, b + 1)}))
            rows = rows.filter(reduce(lambda a, b: a | b, [F.startswith(F.col("term"), F.lit(t)) for t in terms]) if prefix else F.col("term").isin(terms))
            out.append(rows.drop("lot").withColumn("segment", F.lit(s["number"])))
        return reduce(DataFrame.union, out)

    def _opened(self, rows: DataFrame) -> DataFrame:
        """A row for each document of postings: term, rowid, len, tf, at; those that live."""
        fields, opened = ["term", "block", "n", "body"], _entries(len(self.state["columns"]), self.shift)
        if not self.state["dead"]:
            return rows.select(*fields).mapInArrow(opened, HIT)
        parts = [rows.filter(F.col("segment") == s["number"]).select(*fields).mapInArrow(opened, HIT).withColumn("segment", F.lit(s["number"])) for s in self.state["segments"]]
        return reduce(DataFrame.union, parts).join(self._dead(), ["rowid", "segment"], "left_anti").drop("segment")

    def hits(self, terms: list[str], prefix: bool = False) -> DataFrame:
        return self._opened(self.of(terms, prefix))

    def having(self, part: str, column: int | None = None) -> DataFrame:
        """rowid of the documents with a word, a phrase (words with spaces) or a prefix (``*`` at the
        end); with ``column``, in that column only (for a word or prefix)."""
        words = part.split()
        hits = self.hits([part[:-1]], True) if part.endswith("*") else self.hits(list(dict.fromkeys(words)))
        if column is not None:
            hits = hits.filter(F.col("tf")[column] > 0)
        if len(words) == 1:
            return hits.select("rowid").distinct()
        # places of each word, moved back by its order: the phrase stands where all agree
        by = hits.groupBy("rowid").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at"))
        starts = [_moved(F.try_element_at("at", F.lit(w)), k) for k, w in enumerate(words)]
        return by.filter(F.size(reduce(F.array_intersect, starts)) > 0).select("rowid")

    def search(self, every: list[str], none: list[str] | None = None, some: list[str] | None = None) -> DataFrame:
        """rowid of the documents with every part, one of ``some`` and none of ``none``."""
        found = [self.having(p) for p in every]
        if some:
            found.append(reduce(DataFrame.union, [self.having(p) for p in some]).distinct())
        out = reduce(lambda a, b: a.join(b, "rowid", "left_semi"), found)
        for p in none or []:
            out = out.join(self.having(p), "rowid", "left_anti")
        return out

    def _frequency(self, terms: list[str]) -> dict[str, int]:
        if self.state["dead"]:
            rows = self.hits(terms).groupBy("term").agg(F.count("*"))
        else:
            rows = self.of(terms).groupBy("term").agg(F.sum("n"))  # no entry is read
        return {r.term: r[1] for r in rows.collect()}  # a row a query term

    def top(self, terms: list[str], k: int, weights: list[float] | None = None, k1: float = 1.2, b: float = 0.75, probe: int = 16) -> DataFrame:
        """score, key and kept columns of the best ``k`` documents that have all terms, ties to the
        smaller key; more negative is better."""
        terms = list(dict.fromkeys(terms))
        weights = weights or [1.0] * len(self.state["columns"])
        df, n, mean = self._frequency(terms), self.state["n"], self.state["mean"]
        raw = {t: float(np.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) for t in terms}
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t, raw[t] if raw[t] > 0 else 1e-6)])

        def part(tf: Column | list[Column], size: Column) -> Column:
            weighed = reduce(lambda x, y: x + y, [tf[c] * F.lit(float(w)) for c, w in enumerate(weights)])
            return idf[F.col("term")] * weighed * (k1 + 1) / (weighed + k1 * (1 - b + b * size / F.lit(float(mean or 1))))

        def scored(rows: DataFrame) -> DataFrame:
            each = self._opened(rows).select("rowid", part(F.col("tf"), F.col("len")).alias("s"), "term")
            return each.groupBy("rowid").agg(F.count("*").alias("_n"), F.sum("s").alias("s")).filter(F.col("_n") == len(terms)).select("rowid", F.round(-F.col("s"), 6).alias("score"))

        rows = self.of(terms)
        heads = rows.select("term", "block", part([F.col(f"most{c}") for c in range(len(weights))], F.col("least")).alias("bound"))  # no entry is read
        bounds = heads.groupBy("block", "term").agg(F.max("bound").alias("bound")).groupBy("block").agg(F.count("*").alias("_n"), F.sum("bound").alias("bound")).filter(F.col("_n") == len(terms))
        heads = bounds.orderBy(F.desc("bound"), "block").select("block", "bound").limit(NAMED + 1).collect()
        best = [r.block for r in heads[:probe]]
        seen = scored(rows.filter(F.col("block").isin(best))).orderBy("score").limit(k).agg(F.count("*"), F.max("score")).first()
        reach = -seen[1] - 1e-6 if seen[0] == k else float("-inf")
        if len(heads) <= NAMED or heads[-1].bound < reach:
            able = scored(rows.filter(F.col("block").isin([r.block for r in heads if r.bound >= reach])))
        else:
            able = scored(rows.join(bounds.filter(F.col("bound") >= reach).select("block"), "block", "left_semi"))
        if seen[0] == k:
            able = able.filter(F.col("score") <= seen[1])
        return self.keyed(able).orderBy("score", self.state["key"]).limit(k)

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the key and the kept columns of their documents in place of row numbers."""
        docs = self.documents().drop("_digest", "_segment")
        return _meeting(docs, "rowid", rows).join(rows, "rowid").drop("rowid")
