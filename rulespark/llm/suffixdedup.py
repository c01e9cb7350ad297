"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

*Which suffixes.* Every window of ``length`` bytes picks its first ``gram``-byte gram of least hash.
Consecutive window starts with the same pick form a *run*; its first start is a sampled suffix, about
one in 35 bytes. Equal windows pick equal grams, so equal strings meet under one key wherever they
stand. A run is stored as (h, c, did): the pick, the fingerprint of all bytes its windows cover, and
the document. The array of a batch is its runs in the order (h, c), in buckets of h. That is an order of
fingerprints, not of letters: what is asked is which suffixes share 100 bytes, and letters would have
to be stored, several times the text, to be compared.

*Which levels.* Batches come in order of document id. A new batch's array is scanned side by side with
all levels, bucket by bucket; levels stay where they are, only the batch is dealt out. A run with an
equal (h, c) in an earlier document is repeated as a whole; runs that share only h may share a part.
The batch then becomes a level of its own, and levels of equal size merge, so b batches leave at most
log2(b) + 1 levels and an entry is rewritten log2(b) times. An index that is given a folder stays there,
and later documents are scanned against it.

*Parts.* Runs that share only h are looked at again in two finer steps, of each (h, c) only the first:
the windows of its later copies are repeated anyway. Windows at offsets 8 j to 8 j + 7 from the picked
gram form a *block*; its core, the bytes that all its windows have in common, and the picked gram are
its key. Blocks are then judged as runs were: an equal block in an earlier document repeats it as a
whole, and only blocks that share their core alone list their single windows.

Repeats inside a document are found in the last pass, which recomputes the document's runs. Strings
are compared by two 64-bit fingerprints, h and c or h and the window's. Entries that many texts of a
slice have are one row with a list of ids before they are dealt out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .neardup import NULL_ID
from .scratch import Scratch

LENGTH = 100
GRAM = 32
BATCHES = 4
BLOCK = 8
#: Runs whose blocks are worked out at once.
RUNS = 20_000
ENTRY = "h long, c long, new long, newest long, dids array<long>"
LEVEL = "h long, c long, did long"
#: Lists of partly repeated runs or blocks are broadcast up to so many rows (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 2_000_000
TOP = T.U64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[width - span : width - span + n]) if span < width else have[:n]


class Runs:
    """The runs of the texts of a slice: h, c, start, n (number of window starts), doc (index of the text)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
        self.sums, self.length, self.offs, self.reach = T.prefix(buf), length, offs, length - gram
        n = len(buf) - length + 1
        empty = np.zeros(0, np.int64)
        self.h, self.c, self.start, self.n, self.doc = empty.view(T.U64), empty.view(T.U64), empty, empty, empty
        if n <= 0:
            return
        at = np.arange(len(buf) - gram + 1)
        self.grams = grams = T.spans_hash(self.sums, at, at + gram)
        pick = sliding_min(grams, length - gram + 1)
        valid = np.zeros(len(buf) + 1, dtype=np.int8)
        ok = offs[1:] - offs[:-1] >= length
        valid[offs[:-1][ok]] += 1
        valid[offs[1:][ok] - length + 1] -= 1
        valid = np.cumsum(valid[:n]).astype(bool)
        new = valid.copy()
        # another gram, or the same gram at a later place: equal windows never share a run
        new[1:] &= (pick[1:] != pick[:-1]) | (grams[: n - 1] == pick[:-1]) | ~valid[:-1]
        first = offs[:-1][ok]
        new[first] = True
        self.start = np.flatnonzero(new)
        if not len(self.start):
            return
        # a run ends before the next one, or with the last valid start of its text
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        last = offs[1:][self.doc] - length + 1
        self.n = np.minimum(np.append(self.start[1:], len(buf)), last) - self.start
        self.h = pick[self.start]
        self.c = T.spans_hash(self.sums, self.start, self.start + self.n - 1 + length)

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(run index, key, fingerprint, first window start, windows) of every block of the given runs."""
        if len(which) > RUNS:
            parts = [self.blocks(which[i : i + RUNS]) for i in range(0, len(which), RUNS)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        start, n, h = self.start[which], self.n[which], self.h[which]
        place = np.minimum(start[:, None] + np.arange(self.reach + 1), len(self.grams) - 1)
        picked = start + (self.grams[place] == h[:, None]).argmax(axis=1)
        zero = picked - self.reach  # a window that starts here has offset 0
        low, high = (start - zero) // BLOCK, (start + n - 1 - zero) // BLOCK
        many = high - low + 1
        of = np.repeat(np.arange(len(which)), many)
        j = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        core = zero[of] + BLOCK * j
        first, last = np.maximum(start[of], core), np.minimum((start + n - 1)[of], core + BLOCK - 1)
        key = T.mix(T.spans_hash(self.sums, np.minimum(core + BLOCK - 1, core + self.length), core + self.length) + h[of] * T.U64(T.BASE) + j.astype(T.U64))
        return which[of], key, T.mix(T.spans_hash(self.sums, first, last + self.length) + key), first, last - first + 1

    def window_hash(self, starts: np.ndarray) -> np.ndarray:
        return T.spans_hash(self.sums, starts, starts + self.length)


def _grouped(h: np.ndarray, c: np.ndarray, did: np.ndarray) -> pa.RecordBatch:
    """A row for each (h, c), with the different ids that have it."""
    order = np.lexsort((did, c, h))
    h, c, did = h[order], c[order], did[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    keep = new.copy()
    keep[1:] |= did[1:] != did[:-1]
    new, h, c, did = new[keep], h[keep], c[keep], did[keep]
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(h))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(did))
    return pa.RecordBatch.from_arrays([pa.array(T.signed(h[first])), pa.array(T.signed(c[first])), pa.array(did[first]), pa.array(did[ends - 1]), lists], names=["h", "c", "new", "newest", "dids"])


def _entries(length: int, gram: int):
    """``ENTRY`` rows of the runs of each slice."""

    def run(batches):
        for part in T.slices(batches):
            r = Runs(*T.packed(part.column(1)), length, gram)
            if len(r.start):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield _grouped(r.h, r.c, ids[r.doc])

    return run


def _spread(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, start) of every window of the stretches of n windows."""
    of = np.repeat(np.arange(len(n)), n)
    return of, starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _listed(part: pa.RecordBatch, column: int, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the list of its text; ``doc`` is sorted."""
    bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
    take = np.zeros(len(doc), dtype=bool)
    cells = part.column(column)
    for i in range(part.num_rows):
        if cells[i].is_valid:
            a, b = bounds[i], bounds[i + 1]
            take[a:b] = np.isin(values[a:b], np.asarray(cells[i].values).view(T.U64))
    return take


def _rows(part: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return _grouped(key, c, part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc])


def _part_blocks(length: int, gram: int):
    """Rows (did, text, runs): ``ENTRY`` rows of the blocks of the listed runs."""

    def run(batches):
        for part in T.slices(batches):
            r = Runs(*T.packed(part.column(1)), length, gram)
            which = np.flatnonzero(_listed(part, 2, r.doc, r.c))
            if len(which):
                of, key, c, _, _ = r.blocks(which)
                yield _rows(part, r.doc[of], key, c)

    return run


def _part_windows(length: int, gram: int):
    """Rows (did, text, blocks): ``ENTRY`` rows of the windows of the listed blocks, by the key of the block."""

    def run(batches):
        for part in T.slices(batches):
            r = Runs(*T.packed(part.column(1)), length, gram)
            if not len(r.start):
                continue
            of, key, c, first, n = r.blocks(np.arange(len(r.start)))
            which = np.flatnonzero(_listed(part, 2, r.doc[of], c))
            if len(which):
                block, starts = _spread(first[which], n[which])
                yield _rows(part, r.doc[of[which[block]]], key[which[block]], r.window_hash(starts))

    return run


def _marked(r: Runs, i: int, a: int, b: int, runs: np.ndarray, blocks: np.ndarray, windows: np.ndarray) -> np.ndarray | None:
    """Starts of the repeated windows of text i, whose runs are a to b."""
    found = []
    if len(runs):
        whole = np.flatnonzero(np.isin(r.c[a:b], runs)) + a
        found.append(_spread(r.start[whole], r.n[whole])[1])
    if len(blocks):
        _, _, c, first, n = r.blocks(np.arange(a, b))
        whole = np.isin(c, blocks)
        found.append(_spread(first[whole], n[whole])[1])
    if len(windows):
        starts = np.arange(r.offs[i], r.offs[i + 1] - r.length + 1)
        found.append(starts[np.isin(r.window_hash(starts), windows)])
    h = r.h[a:b]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if same.any():
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        which = np.flatnonzero(twice) + a
        starts = _spread(r.start[which], r.n[which])[1]
        _, first = np.unique(r.window_hash(starts), return_index=True)
        later = np.ones(len(starts), dtype=bool)
        later[first] = False
        found.append(starts[later])
    return np.concatenate(found) if found else None


def kept_pieces(data: np.ndarray, starts: np.ndarray | None, length: int) -> tuple[np.ndarray, int, int]:
    """(mask of kept bytes, removed bytes, maximal removed runs)."""
    keep = np.ones(len(data), dtype=bool)
    if starts is None or not len(starts):
        return keep, 0, 0
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return ~gone, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())


def whole_characters(data: np.ndarray, keep: np.ndarray) -> str:
    """The kept bytes as text; a character that would be cut is kept whole."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - lead[0] if len(data) else lead
    kept = np.zeros(int(char[-1]) + 1 if len(data) else 0, dtype=bool)
    kept[char[keep]] = True
    return data[kept[char]].tobytes().decode("utf-8", "replace") if len(data) else ""


def _cut(length: int, gram: int, with_text: bool):
    """Rows (row, text, runs, blocks, windows): the row and what is left of its text."""

    def run(batches):
        for part in T.slices(batches):
            buf, offs = T.packed(part.column(1))
            r = Runs(buf, offs, length, gram)
            bounds = np.searchsorted(r.doc, np.arange(part.num_rows + 1))
            lists = part.column(2), part.column(3), part.column(4)
            out = ([], [], [], [], [])
            for i in range(part.num_rows):
                data = buf[offs[i] : offs[i + 1]]
                known = [np.asarray(x[i].values).view(T.U64) if x[i].is_valid else np.zeros(0, T.U64) for x in lists]
                starts = _marked(r, i, bounds[i], bounds[i + 1], *known) if len(data) >= length else None
                keep, gone, spans = kept_pieces(data, None if starts is None else starts - offs[i], length)
                out[0].append(len(data))
                out[1].append(gone)
                out[2].append(spans)
                out[3].append(hashlib.sha256((data[keep] if gone else data).tobytes()).hexdigest())
                if with_text:
                    out[4].append(whole_characters(data, keep) if gone else data.tobytes().decode("utf-8", "replace"))
            made = [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.string())] + [pa.array(out[4], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    return run


class LogSuffixIndex:
    """The levels, least recent first, as tables (h, c, did) in buckets of h, with their size classes.

    With a ``root`` the levels stay in that folder, and ``LogSuffixIndex(spark, root)`` opens them again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.root, self.length, self.gram = spark, root.rstrip("/") if root else None, length, gram
        self.tmp = Scratch(spark, "suffix")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []
        if self.root and (told := self._read()):
            self.length, self.gram, self.buckets = told["length"], told["gram"], told["buckets"]
            self.levels = [(x["size"], self.tmp.open_by(f"{self.root}/{x['path']}", LEVEL, "h", self.buckets, ("h", "c"))) for x in told["levels"]]

    def _state(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/levels.json")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _read(self) -> dict | None:
        fs, path = self._state()
        return json.loads(self.spark.read.text(f"{self.root}/levels.json", wholetext=True).first()[0]) if fs.exists(path) else None

    def _write(self) -> None:
        """The levels' names go into the folder last, so a run that fails leaves the old ones in force."""
        levels = [{"size": size, "path": level._scratch_path.removeprefix(f"{self.root}/")} for size, level in self.levels]
        fs, path = self._state()
        out = fs.create(path, True)
        out.write(json.dumps({"length": self.length, "gram": self.gram, "buckets": self.buckets, "levels": levels}).encode())
        out.close()

    def array(self, texts: DataFrame, cut) -> DataFrame:
        """What ``cut`` makes of the texts, dealt out by h once."""
        # a stored column for what levels add: a union whose first side makes up a column loses its partitioning
        rows = texts.mapInArrow(cut, ENTRY).withColumn("old", F.lit(None).cast("long"))
        return self.tmp.save_by(rows.repartition(self.buckets, "h"), "h", self.buckets)

    def scan(self, entries: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """(h, c, first, newest, old, shared): entries and level rows side by side.

        ``shared``: the h has another c too, and the entries have it.
        """
        none = F.lit(None).cast("long")
        both = entries.select("h", "c", "new", "newest", "old")
        for level in levels:
            both = both.union(level.select("h", "c", none, none, F.col("did")))
        by = Window.partitionBy("h")
        found = (
            both.groupBy("h", "c").agg(F.min("new").alias("new"), F.max("newest").alias("newest"), F.min("old").alias("old"))
            .withColumn("shared", (F.min("c").over(by) != F.max("c").over(by)) & F.max(F.col("new").isNotNull()).over(by))
            .filter("new is not null or shared").withColumn("first", F.coalesce("old", "new"))
        )
        return self.tmp.save_by(found, "h", self.buckets)

    def judged(self, entries: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((did, c) of entries that an earlier document has too, (did, c) of the firsts that share only their h)."""
        whole = scanned.filter("newest > first").select("h", "c", "first")
        later = entries.select("h", "c", "dids").join(whole, ["h", "c"]).select(F.explode(F.filter("dids", lambda d: d > F.col("first"))).alias("did"), "c")
        return self.tmp.save(later), self.tmp.save(scanned.filter("shared").select(F.col("first").alias("did"), "c"))

    def add(self, batch: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """Scan a batch (did, text), whose ids exceed all earlier ones', and keep it as a level.

        Returns (did, c) of its wholly repeated runs, and (did, c) of all runs that may be repeated in part.
        """
        entries = self.array(batch, _entries(self.length, self.gram))
        scanned = self.scan(entries, [level for _, level in self.levels])
        repeated, part = self.judged(entries, scanned)
        self.tmp.drop(entries)
        if keep:
            self._put(scanned.filter("old is null").select("h", "c", F.col("new").alias("did")))
        self.tmp.drop(scanned)
        return repeated, part

    def _put(self, rows: DataFrame) -> None:
        """Take rows in as a level; as long as the last level is of its size, the two become one of the next."""
        size, merged = 0, []
        while self.levels and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            rows, size = merged[-1].select("h", "c", "did").union(rows), size + 1
        path = f"{self.root}/{uuid.uuid4().hex}" if self.root else None
        self.levels.append((size, self.tmp.save_by(rows, "h", self.buckets, ("h", "c"), path)))
        if self.root:
            self._write()
        self.tmp.drop(*merged)

    def drop(self) -> None:
        self.tmp.drop(*[level for _, level in self.levels])
        self.levels = []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False, index: LogSuffixIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) for every row; ``row`` is the input row.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document with a smaller
    id, or earlier in the same row. Strings are judged on the input, and matches never cross rows. A
    null text is empty; a null id is less than any other; rows with the same id do not remove each other's bytes. ``kept_text``
    keeps a character whole if only some of its bytes would go. Extra columns stay in ``row``; an
    empty table gives no rows.

    With an ``index``, the documents are also judged against those that it holds, and it takes them in;
    their ids must exceed those, and ``earlier`` must have the texts that it was built from, which are
    read for parts of runs.
    """
    spark: SparkSession = docs.sparkSession
    kept = index is not None
    index = index if kept else LogSuffixIndex(spark, None, length, gram)
    tmp, length, gram = index.tmp, index.length, index.gram
    known = lambda df: df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = known(docs) if earlier is None else known(earlier).union(known(docs))
    cuts = src.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    repeated, part = [], []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = src.select("did", "text")
        if low is not None:
            batch = batch.filter(F.col("did") > low)
        if high is not None:
            batch = batch.filter(F.col("did") <= high)
        whole, some = index.add(batch, keep=kept or high is not None)
        repeated.append(whole)
        part.append(some)
    if not kept:
        index.drop()
    block_repeats, block_part = _finer(texts, reduce(DataFrame.union, part), index, _part_blocks(length, gram))
    tmp.drop(*part)
    window_repeats, window_part = _finer(texts, block_part, index, _part_windows(length, gram))
    tmp.drop(block_part, window_part)
    listed = lambda df, name: df.groupBy("did").agg(F.collect_list("c").alias(name))
    lists = listed(reduce(DataFrame.union, repeated), "runs").join(listed(block_repeats, "blocks"), "did", "full").join(listed(window_repeats, "windows"), "did", "full")
    lists = tmp.save(lists)
    tmp.drop(*repeated, block_repeats, window_repeats)
    kind = f"row {src.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return src.join(lists, "did", "left").select("row", "text", "runs", "blocks", "windows").mapInArrow(_cut(length, gram, with_text), kind)


def _finer(texts: DataFrame, part: DataFrame, index: LogSuffixIndex, cut) -> tuple[DataFrame, DataFrame]:
    """``index.judged`` of what ``cut`` makes of the texts that hold a listed (did, c)."""
    tmp = index.tmp
    part = tmp.save(part.groupBy("did").agg(F.collect_set("c").alias("cs")))
    few = (part.agg(F.sum(F.size("cs"))).first()[0] or 0) <= BROADCAST_ROWS
    entries = index.array(texts.join(F.broadcast(part) if few else part, "did").select("did", "text", "cs"), cut)
    scanned = index.scan(entries, [])
    found = index.judged(entries, scanned)
    tmp.drop(part, entries, scanned)
    return found
