"""Ranked lexical search by Block-Max WAND over segments of an inverted index.

A segment indexes some documents that one task reads: no posting is shuffled, and no list of a frequent
word is longer than a segment. Lists are cut into blocks of ``BLOCK`` postings, packed to the bits that
their gaps and counts need. Beside the packed bytes a block keeps its first and last document and the
greatest impact in it, under the statistics of the whole table.

A query cuts a segment at the ends of its lists' blocks into ranges, in each of which every list has one
block at most: the lists' pointers move over the ranges by those bounds alone, no block is unpacked. The
sum of the blocks' greatest scores bounds a range; ranges under the threshold, the k-th best score so far,
are skipped. In the others lists are ordered by their greatest score there; those before the pivot, where
the running sum reaches the threshold, cannot lift a document alone. The blocks from the pivot on are
unpacked first, those before it only where a document found so far can still reach the threshold. Ranges
with high bounds come first, some at a time, so that the threshold rises early. Scores are whole numbers
and nothing but certain losers is skipped, so the result equals that of scoring every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch, set_for

BLOCK = 64
#: Bytes of text in a segment, about; one text is never cut.
SEGMENT_BYTES = 4 << 20
#: Rows that go to Python at once while the index is built; a batch of long texts is no larger than it must be.
BUILD_ROWS = 1024
#: Ranges of the first wave; each wave takes four times the ranges of the last.
WAVE = 16
#: Characters of items that are searched in one pass over the index.
PASS_CHARS = 4_000_000
#: With more segments than four times so many, as many give a first threshold for the others.
FIRST_SEGMENTS = 64
SECOND_BASE = 0xD6E8FEB86659FD93

SEGMENT = "docs array<long>, lengths binary, key binary, key2 binary, list_docs binary, list_block binary, first binary, last binary, most binary, count binary, gap_bits binary, tf_bits binary, at binary, data binary"


@dataclass(frozen=True)
class Index:
    """Segments as a table, and the statistics that their impacts were made with."""

    segments: DataFrame
    documents: int
    terms: int


def terms_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two fingerprints of each term, index of each text's first term and the end).

    Terms are runs of ASCII letters and digits and of all characters outside ASCII, with A-Z in lower
    case. Together the fingerprints have 128 bits; terms that share both would count as one.
    """
    low = T.lowered(buf)
    starts, ends, first = T.word_bounds(low, offs, T.ALNUM)
    sums = np.zeros(len(low) + 1, T.U64)
    np.cumsum((low.astype(T.U64) + T.U64(1)) * T.powers(SECOND_BASE, len(low)), out=sums[1:])
    down = T.powers(pow(SECOND_BASE, -1, 1 << 64), len(low) + 1)
    return T.word_hashes(low, starts, ends), T.mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(T.U64)), first


def penalty(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length adds: 10 and nine tenths of its length in per cent of the mean."""
    return 100 - 90 + (90 * lengths.astype(np.int64) * documents) // max(1, terms)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The saturated count of a term in a document, in millionths."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    """The weight of a term that so many documents hold, in thousandths."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def bits(values: np.ndarray) -> np.ndarray:
    """Bits that whole numbers need; none for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Write numbers of some bits each at given places among the single bits of ``out``."""
    for b in range(int(width.max(initial=0))):
        some = width > b
        out[at[some] + b] = (values[some] >> b) & 1


def unpack(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of under 57 bits at given bit places; ``data`` has eight spare bytes at its end."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return ((words[at >> 3] >> (at & 7).astype(T.U64)) & ((T.U64(1) << width.astype(T.U64)) - T.U64(1))).astype(np.int64)


def segment_of(ids: pa.Array, lengths: np.ndarray, key: np.ndarray, key2: np.ndarray, doc: np.ndarray, m: np.ndarray, block: int) -> dict:
    """The columns of one segment, from the fingerprints and documents of its terms in the order of documents."""
    by = np.argsort(key, kind="stable")
    if (key2[by][1:] != key2[by][:-1])[key[by][1:] == key[by][:-1]].any():
        by = np.lexsort((key2, key))
    key, key2, doc = key[by], key2[by], doc[by]
    new_list = np.append(True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]))[: len(key)]
    posting = np.flatnonzero(new_list | np.append(True, doc[1:] != doc[:-1])[: len(key)])
    tf = np.diff(np.append(posting, len(key)))
    doc, starts = doc[posting], new_list[posting]
    lists = np.flatnonzero(starts)
    held = np.diff(np.append(lists, len(posting)))
    place = np.arange(len(posting)) - np.repeat(lists, held)
    opens = place % block == 0
    blocks = np.flatnonzero(opens)
    count = np.diff(np.append(blocks, len(posting)))
    gap = np.diff(doc, prepend=0) - 1
    gap[opens] = 0
    worth = impact(tf, m[doc])
    top = lambda v: np.maximum.reduceat(v, blocks) if len(blocks) else v
    gap_bits, tf_bits = bits(top(gap)), bits(top(tf - 1))
    size = (count * (gap_bits.astype(np.int64) + tf_bits) + 7) // 8
    at = np.cumsum(size) - size
    of = np.repeat(np.arange(len(blocks)), count)
    nth = np.arange(len(posting)) - blocks[of] if len(blocks) else np.zeros(0, np.int64)
    loose = np.zeros(int(size.sum()) * 8, np.uint8)
    pack(gap, at[of] * 8 + nth * gap_bits[of], gap_bits[of], loose)
    pack(tf - 1, at[of] * 8 + count[of] * gap_bits[of] + nth * tf_bits[of], tf_bits[of], loose)
    binary = lambda v, kind: v.astype(kind).tobytes()
    return {
        "docs": ids, "lengths": binary(lengths, "<i8"), "key": binary(key[posting[lists]], "<u8"), "key2": binary(key2[posting[lists]], "<u8"), "list_docs": binary(held, "<i4"),
        "list_block": binary(np.append(np.searchsorted(blocks, lists), len(blocks)), "<i4"), "first": binary(doc[blocks], "<i4"), "last": binary(doc[np.append(blocks[1:], len(posting))[: len(blocks)] - 1], "<i4"),
        "most": binary(top(worth), "<i4"), "count": binary(count, "<u1"), "gap_bits": binary(gap_bits, "<u1"), "tf_bits": binary(tf_bits, "<u1"), "at": binary(at, "<i8"), "data": np.packbits(loose, bitorder="little").tobytes(),
    }


def _indexer(documents: int, terms: int, segment_bytes: int, block: int):
    """Segments of the texts that one task reads, as rows of ``SEGMENT``; it holds the terms of one segment at a time."""

    def run(batches):
        ids, lengths, key, key2, doc = [], [], [], [], []
        size = 0

        def closed():
            held, docs = np.concatenate(lengths), pa.concat_arrays(ids)
            flat = [np.concatenate(x) for x in (key, key2, doc)]
            for kept in (ids, lengths, key, key2, doc):
                kept.clear()
            row = segment_of(docs, held, *flat, penalty(held, documents, terms), block)
            names = [c.split()[0] for c in SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c]) if c == "docs" else pa.array([row[c]], pa.binary()) for c in names], names=names)

        for part in T.slices(batches):
            buf, offs = T.packed(part.column(1))
            a, b, first = terms_of(buf, offs)
            held = np.diff(first)
            some = np.flatnonzero(held)
            if not len(some):
                continue
            if size and size + len(buf) > segment_bytes:
                yield closed()
                size = 0
            base = sum(map(len, ids))
            doc.append(np.repeat(base + np.arange(len(some)), held[some]).astype(np.int32))
            column = part.column(0).take(pa.array(some))
            ids.append(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
            lengths.append(held[some])
            key.append(a)
            key2.append(b)
            size += len(buf)
        if size:
            yield closed()

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, segment_bytes: int = SEGMENT_BYTES, block: int = BLOCK) -> Index:
    """An index of every row, in the folder ``path`` if it is given.

    Texts are read twice, first for the statistics. A null text has no terms; a text without terms is
    no document. Repeated rows, repeated ids and rows with a null id are documents each. Texts of any
    length are indexed whole, one alone in a segment if it is long. Extra columns are ignored.
    """
    if not 0 < block < 256:
        raise ValueError("block must be 1 to 255")
    spark = docs.sparkSession
    tmp = Scratch(spark, "blockmax")
    src = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def counted(batches):
        n = total = 0
        for part in T.slices(batches):
            buf, offs = T.packed(part.column(1))
            held = np.diff(T.word_bounds(buf, offs, T.ALNUM)[2])
            n, total = n + int((held > 0).sum()), total + int(held.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    sums = src.mapInArrow(counted, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    documents, terms = sums.n or 0, sums.total or 0

    table = src.mapInArrow(_indexer(documents, terms, segment_bytes, block), SEGMENT)
    with set_for(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BUILD_ROWS):
        if path is None:
            return Index(tmp.save(table), documents, terms)
        table.write.parquet(f"{path}/segments")
    spark.createDataFrame([(documents, terms)], "documents long, terms long").coalesce(1).write.parquet(f"{path}/statistics")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written to a folder."""
    known = spark.read.parquet(f"{path}/statistics").first()
    return Index(spark.read.parquet(f"{path}/segments"), known.documents, known.terms)


@dataclass
class Best:
    """The k best of an item so far: by score, then by id, a null id first."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: int = 1

    @property
    def threshold(self) -> int:
        """A document below it is not among the k best."""
        return max(self.least, int(self.score[-1])) if len(self.score) == self.k else self.least

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        score, known, doc = np.concatenate([self.score, score]), np.concatenate([self.known, known]), np.concatenate([self.doc, doc])
        by = np.lexsort((doc, known, -score))[: self.k]
        self.score, self.known, self.doc = score[by], known[by], doc[by]


class Segment:
    """One segment in a task. Blocks are unpacked once, when a query first needs them."""

    def __init__(self, row: dict, documents: int, terms: int):
        of = lambda c, kind: np.frombuffer(row[c], kind)
        ids: pa.Array = row["docs"]
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.m = penalty(of("lengths", "<i8"), documents, terms)
        self.key, self.key2, self.list_docs, self.list_block = of("key", "<u8"), of("key2", "<u8"), of("list_docs", "<i4"), of("list_block", "<i4")
        self.first, self.last, self.most, self.count = of("first", "<i4"), of("last", "<i4"), of("most", "<i4"), of("count", "<u1").astype(np.int64)
        self.gap_bits, self.tf_bits, self.at = of("gap_bits", "<u1").astype(np.int64), of("tf_bits", "<u1").astype(np.int64), of("at", "<i8")
        self.data = np.frombuffer(row["data"] + bytes(8), np.uint8)
        self.start = np.cumsum(self.count) - self.count
        self.doc, self.worth = np.empty(int(self.count.sum()), np.int32), np.empty(int(self.count.sum()), np.int32)
        self.open = np.zeros(len(self.first), bool)

    def lists(self, key: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """The number of each term's list, or -1."""
        return find(self.key, self.key2, key, key2)

    def unpacked(self, blocks: np.ndarray) -> None:
        """Documents and impacts of these blocks, unless they are there."""
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        n = self.count[blocks]
        of = np.repeat(blocks, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gap = unpack(self.data, self.at[of] * 8 + nth * self.gap_bits[of], self.gap_bits[of]) + 1
        tf = unpack(self.data, self.at[of] * 8 + self.count[of] * self.gap_bits[of] + nth * self.tf_bits[of], self.tf_bits[of]) + 1
        gap[nth == 0] = 0
        run = np.cumsum(gap)
        doc = run - np.repeat(run[np.cumsum(n) - n], n) + self.first[of]
        at = self.start[of] + nth
        self.doc[at], self.worth[at] = doc, impact(tf, self.m[doc])
        self.open[blocks] = True

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each posting of these blocks, and the index of its block among them)."""
        self.unpacked(blocks)
        n = self.count[blocks]
        return np.repeat(self.start[blocks] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(blocks)), n)

    def search(self, lists: np.ndarray, weights: np.ndarray, best: Best, wave: int = WAVE) -> None:
        """Block-Max WAND over the lists of an item."""
        low, high = self.list_block[lists], self.list_block[lists + 1]
        edges = np.unique(np.concatenate([self.last[a:b] for a, b in zip(low, high, strict=True)]))
        starts = np.append(0, edges[:-1] + 1)
        # shallow pointers: in each range the block of each list that ends at or after it
        block = np.stack([a + np.searchsorted(self.last[a:b], starts) for a, b in zip(low, high, strict=True)])
        inside = block < high[:, None]
        block = np.where(inside, block, 0)
        inside &= self.first[block] <= edges
        most = np.where(inside, self.most[block] * weights[:, None], 0)
        bound = most.sum(axis=0)
        order = np.argsort(-bound, kind="stable")
        at = 0
        while at < len(order) and bound[order[at]] >= best.threshold:
            some = order[at : at + wave]
            at, wave = at + wave, wave * 4
            some = np.sort(some[bound[some] >= best.threshold])
            self._scored(block[:, some], inside[:, some], most[:, some], starts[some], edges[some], weights, best)

    def _scored(self, block, inside, most, starts, ends, weights, best: Best) -> None:
        """Score the documents of some ranges that can reach the threshold."""
        threshold = best.threshold
        # the pivot: lists from the least greatest score on whose sum stays below the threshold come later
        by = np.argsort(most, axis=0, kind="stable")
        running = np.take_along_axis(most, by, axis=0).cumsum(axis=0)
        later = np.zeros(most.shape, bool)
        np.put_along_axis(later, by, running < threshold, axis=0)
        rest = np.where(later, most, 0).sum(axis=0)
        score, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)

        def add(wanted: np.ndarray, only: np.ndarray | None) -> None:
            row, col = np.nonzero(wanted)
            blocks, one = np.unique(block[row, col], return_index=True)  # a block belongs to one list
            place, of = self.postings(blocks)
            doc, row = self.doc[place], row[one][of]
            col = np.searchsorted(ends, doc)
            ok = col < len(ends)
            col = np.where(ok, col, 0)
            ok &= (starts[col] <= doc) & wanted[row, col]
            if only is not None:
                ok &= only[doc]
            np.add.at(score, doc[ok], self.worth[place[ok]] * weights[row[ok]])
            seen[doc[ok]] = True

        add(inside & ~later, None)
        docs = np.flatnonzero(seen)
        docs = docs[score[docs] + rest[np.searchsorted(ends, docs)] >= threshold]
        if not len(docs):
            return
        if (inside & later).any():
            needed, only = np.zeros(len(ends), bool), np.zeros(len(self.ids), bool)
            needed[np.searchsorted(ends, docs)] = only[docs] = True
            add(inside & later & needed, only)
        docs = docs[score[docs] >= threshold]
        best.add(score[docs], self.known[docs], self.ids[docs])


def find(key: np.ndarray, key2: np.ndarray, want: np.ndarray, want2: np.ndarray) -> np.ndarray:
    """Where each pair of fingerprints stands among sorted ones, or -1."""
    out = np.full(len(want), -1, np.int64)
    at = np.searchsorted(key, want)
    left = np.flatnonzero(at < len(key))
    while len(left):
        left = left[key[at[left]] == want[left]]
        hit = key2[at[left]] == want2[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < len(key)]
    return out


@dataclass
class Questions:
    """Items as arrays: their terms once each, and the weights of the terms."""

    items: list[int | None]
    key: np.ndarray
    key2: np.ndarray
    terms: list[np.ndarray]
    weights: np.ndarray | None = None


def _questions(rows: list[tuple[int | None, str]]) -> Questions:
    held: dict[int | None, list[np.ndarray]] = {}
    a, b, first = terms_of(*T.packed(pa.array([t for _, t in rows], pa.string())))
    pairs, number = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    for (item, _), x, y in zip(rows, first[:-1], first[1:], strict=True):
        held.setdefault(item, []).append(number.reshape(-1)[x:y])
    terms = {i: np.unique(np.concatenate(t)) for i, t in held.items()}
    return Questions(list(terms), pairs[0], pairs[1], list(terms.values()))


def _passes(items: DataFrame, item_col: str, text_col: str, chars: int):
    """The items with text, as lists of at most about ``chars`` characters; rows of one item stay together."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0").distinct()
    passes = math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / chars)
    for i in range(passes):
        mine = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        if found := [(r.item_id, r.text) for r in mine.collect()]:
            yield found


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i].values if c == "docs" else batch.column(j)[i].as_buffer().to_pybytes() for j, c in enumerate(batch.schema.names)}


def _answers(index: Index, asked: Questions, k: int, tmp: Scratch, first_segments: int, wave: int) -> DataFrame:
    spark = index.segments.sparkSession
    schema = "item int, doc_id long, score long"
    documents, terms = index.documents, index.terms  # tasks get these and not the table

    def holding(batches):
        total = np.zeros(len(asked.key), np.int64)
        for row in _rows(batches):
            at = find(np.frombuffer(row["key"], "<u8"), np.frombuffer(row["key2"], "<u8"), asked.key, asked.key2)
            total += np.where(at >= 0, np.frombuffer(row["list_docs"], "<i4")[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    def searching(weights: np.ndarray, least: list[int]):
        def run(batches):
            best = [Best(k, least=n) for n in least]
            for row in _rows(batches):
                segment = Segment(row, documents, terms)
                where = segment.lists(asked.key, asked.key2)
                for mine, held in zip(best, asked.terms, strict=True):
                    use = held[(where[held] >= 0) & (weights[held] > 0)]
                    if len(use):
                        segment.search(where[use], weights[use], mine, wave)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), [len(b.score) for b in best])), pa.array(np.concatenate([b.doc for b in best]), mask=~np.concatenate([b.known for b in best])), pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"]
            )

        return run

    def ranked(found: DataFrame) -> DataFrame:
        """The k best of each item: first in shares, so that no task gets an item's finds of all tasks."""
        order = [F.desc("score"), F.asc_nulls_first("doc_id")]
        some = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("rank") <= k)
        return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)

    # segments are large rows: one at a time goes to Python
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        held = {r.term: r.n for r in index.segments.select("key", "key2", "list_docs").mapInArrow(holding, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # terms of one pass
        weights = np.array([weight(documents, held[t]) if t in held else 0 for t in range(len(asked.key))], np.int64)
        least = [1] * len(asked.items)
        rows = index.segments
        n = rows.select(F.length("key")).count()
        some = F.pmod(F.xxhash64("key"), F.lit(max(1, n // first_segments))) == 0
        found = []
        if n > 4 * first_segments:
            found.append(tmp.save(ranked(rows.filter(some).mapInArrow(searching(weights, least), schema)).select("item", "doc_id", "score")))
            for r in found[0].groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).collect():
                least[r["item"]] = r.s
            rows = rows.filter(~some)
        found.append(tmp.save(rows.mapInArrow(searching(weights, least), schema)))
    finally:
        spark.conf.set(name, before)
    names = spark.createDataFrame([(i, item) for i, item in enumerate(asked.items)], "item int, item_id long")  # items of one pass
    every = found[0] if len(found) == 1 else found[0].union(found[1])
    return ranked(every).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", chars: int = PASS_CHARS, first_segments: int = FIRST_SEGMENTS, wave: int = WAVE) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` best documents with a score above 0.

    Equal scores are ranked by id, a null id first. An item's terms are those of all its rows, once
    each; null, empty and termless items find nothing. Items beyond ``chars`` characters take several
    passes over the index. Extra columns are ignored; an empty table on either side gives no rows.
    """
    spark = index.segments.sparkSession
    tmp = Scratch(spark, "blockmax")
    found = [_answers(index, _questions(rows), k, tmp, first_segments, wave) for rows in _passes(items, item_col, text_col, chars)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
