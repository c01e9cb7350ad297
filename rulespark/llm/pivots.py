"""Approximate nearest neighbours by a permutation index.

Pivots are directions of a bounded sample; their number grows with the root of the table. A vector is
represented by the order of its ``length`` nearest pivots and posted, with the place, in the inverted
files of those pivots. A query reads the files of its own nearest pivots. Of two orders that lack a
pivot at place ``length``, the footrule distance is a constant less twice the sum of
``length - max(place, place')`` over the pivots they share, so the files alone give it.

Footrule sees directions only. Means over the sample turn it into an expected cosine, which
times the row's length is the expected inner product; with rows of one length the order is that of
the footrule. One cut for a query is taken over all files: the files are read once to count rows by
expected product, and once more for the rows above the cut, which are reranked by exact inner
products. Rows are dealt into blocks with files of their own, so that no file has to fit a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Pivots: PER_ROOT times the root of the number of rows, between the two others.
PER_ROOT, FEWEST, MOST = 12, 256, 4096
SAMPLE = 8192
LENGTH = 80
#: The share of the rows that is reranked for a query, with all ties of the last; never under LEAST.
RERANK = 0.06
LEAST = 1000
#: Rows of a block and queries of a chunk, about. Every row goes to every chunk of queries, so chunks are as
#: large as a task can hold; smaller ones only while there are fewer tasks than would keep the cores busy.
BLOCK = 32_768
CHUNK = 16_384
TASKS_PER_CORE = 3
#: Queries and rows that are worked on at once.
ASKED = 512
SLICE = 4096
#: Bins for a doubling of the expected product, and on either side of 1; rows that expect none are in bin 0.
BINS, SIDE = 16, 2048


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` different directions of the sample."""
    unit = directions(sample)
    _, first = np.unique(np.round(unit, 9), axis=0, return_index=True)
    return unit[np.sort(first)[:count]]


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector, nearest first, ties to the lower number."""
    like = np.round(directions(vectors) @ pivots.T, 9)
    return np.argsort(-like, axis=1, kind="stable")[:, :length].astype(np.int16)


class Files:
    """The inverted files of some orders: per pivot the rows that have it, and what their place is worth."""

    def __init__(self, order: np.ndarray):
        rows, length = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.length = rows, length
        self.pivots, start = np.unique(flat[by], return_index=True)
        self.bounds = np.append(start, len(flat))
        self.row = by // length
        self.worth = (length - by % length).astype(np.int16)

    def file(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[i], self.bounds[i + 1]
        return self.row[a:b], self.worth[a:b]


def shared_worth(queries: np.ndarray, files: Files) -> np.ndarray:
    """queries x rows: the sum over shared pivots of the lesser worth; footrule is a constant less twice that."""
    out = np.zeros((len(queries), files.rows), dtype=np.int16)
    asked = Files(queries)
    for i, j in zip(*np.intersect1d(asked.pivots, files.pivots, assume_unique=True, return_indices=True)[1:], strict=True):
        q, a = asked.file(i)
        x, b = files.file(j)
        out[q[:, None], x] += np.minimum(a[:, None], b)
    return out


def fitted(sample: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The expected cosine for each shared worth: means over pairs of the sample, rising, and joined by lines."""
    some = sample[: min(len(sample), 4096)]
    order, unit = orders(some, pivots, length), directions(some)
    asks = np.arange(0, len(some), max(1, len(some) // 256))
    worth = shared_worth(order[asks], Files(order)).astype(np.int64)
    cosine = unit[asks] @ unit.T
    other = np.ones(worth.shape, bool)
    other[np.arange(len(asks)), asks] = False
    most = length * (length + 1) // 2
    every, x, y = np.arange(most + 1), worth[other], cosine[other]
    if len(x) < 2:
        return every / most
    # bins of equal numbers of pairs; a pivot order shared whole has cosine 1
    by = np.argsort(x, kind="stable")
    parts = np.array_split(by, min(64, len(by)))
    at, mean = np.array([x[i].mean() for i in parts]), np.maximum.accumulate([y[i].mean() for i in parts])
    last = np.append(at[1:] > at[:-1], True)
    at, mean = at[last], mean[last]
    if at[-1] < most:
        at, mean = np.append(at, most), np.append(mean, 1.0)
    return np.interp(every, at, mean) + every * 1e-9


def inner(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in component order, so equal vectors get equal products everywhere."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * query[d]
    return out


def _matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    return pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type).to_numpy().astype(kind).reshape(-1, width)


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, length: int = LENGTH, rerank: float = RERANK, least: int = LEAST, block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest found among the other rows.

    Nearest is the largest inner product in double precision, ties to the smaller id. Rows with a
    null id, and vectors that are null, zero, of another dimension than most, or hold null or
    non-finite components take no part. Rows are other rows if their id differs; a repeated id
    counts once for each different vector. A query has ``k`` rows if there are as many others. The
    candidates of a query do not depend on ``block`` and ``chunk``. Extra columns are ignored; an
    empty table gives no rows.
    """
    spark = table.sparkSession
    tmp = Scratch(spark, "pivots")
    schema = "query_id long, rank int, vec_id long, score double"
    rows = table.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vid"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("asks"))
    sizes = {r.d: r.n for r in rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    rows = rows.filter(F.size("x") == dim)
    first = np.array([r.x for r in rows.orderBy(F.xxhash64("vid"), "vid", "x").limit(sample).collect()])
    axes = choose_pivots(first, pivots or min(MOST, max(FEWEST, math.ceil(PER_ROOT * math.sqrt(sizes[dim])))))
    length = min(length, len(axes))
    cosine = fitted(first, axes, length)
    shared = spark.sparkContext.broadcast(axes)  # MOST directions at most

    def ordered(batches):
        for b in batches:
            if b.num_rows:
                o = orders(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), shared.value, length)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(o) + 1, dtype=np.int32) * length), pa.array(o.ravel()))], names=["vid", "x", "asks", "o"])

    # equal rows once: aggregated before they are dealt out
    one = rows.groupBy("vid", "x").agg(F.max("asks").alias("asks"))
    index = tmp.save(one.mapInArrow(ordered, "vid long, x array<double>, asks boolean, o array<smallint>"))
    counts = index.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    if not counts.q:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(counts.n / block)
    busy = math.ceil(TASKS_PER_CORE * spark.sparkContext.defaultParallelism / blocks)
    chunks = max(math.ceil(counts.q / chunk), min(busy, math.ceil(counts.q / ASKED)))
    wanted = max(least, math.ceil(rerank * counts.n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, seed: F.pmod(F.xxhash64("vid", F.hash("x"), F.lit(seed)), F.lit(n)).cast("int")
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    data = index.select("vid", "x", "o", size.alias("size"), dealt(blocks, 1).alias("block"))
    # its own column names: both sides of the cogroup stem from the same table
    asks = index.filter("asks").select(F.col("vid").alias("qid"), F.xxhash64("vid", "x").alias("qkey"), F.col("x").alias("qx"), F.col("o").alias("qo"), dealt(chunks, 2).alias("qchunk"))

    def expected(left: pa.Table, right: pa.Table):
        """(places of some rows, queries x rows: bins of their expected products); a query's own rows have -1."""
        qid, xid, qo = left["qid"].to_numpy(), right["vid"].to_numpy(), _matrix(left["qo"], length, np.int16)
        o, size = _matrix(right["o"], length, np.int16), np.log2(right["size"].to_numpy())
        log = np.where(cosine > 0, np.log2(np.maximum(cosine, 1e-300)), -np.inf)
        for at in range(0, len(xid), SLICE):
            some = slice(at, at + SLICE)
            raw = log[shared_worth(qo, Files(o[some]))] + size[some]
            bins = np.where(np.isneginf(raw), 0, np.clip(np.floor(raw * BINS) + SIDE, 1, 2 * SIDE - 1)).astype(np.int16)
            bins[qid[:, None] == xid[some]] = -1
            yield at, bins

    def in_turn(work):
        """Some queries of a cell after the others, so that memory does not grow with the chunk."""
        return lambda left, right: pa.concat_tables([work(left.slice(a, ASKED), right) for a in range(0, max(1, left.num_rows), ASKED)])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        """(qkey, bin, n) of the best rows, enough of them for any cut."""
        total = np.zeros((left.num_rows, 2 * SIDE), np.int64)
        if left.num_rows and right.num_rows:
            for _, bins in expected(left, right):
                for i, row in enumerate(bins):
                    total[i] += np.bincount(row[row >= 0], minlength=2 * SIDE)
        above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total
        i, b = np.nonzero((total > 0) & (above < wanted))
        return pa.table({"qkey": left["qkey"].to_numpy()[i] if len(i) else np.zeros(0, np.int64), "bin": b, "n": total[i, b]})

    def reranked(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            qid, xid = left["qid"].to_numpy(), right["vid"].to_numpy()
            q, x, cut = _matrix(left["qx"], dim, np.float64), _matrix(right["x"], dim, np.float64), left["cut"].to_numpy()
            picked: list[list[np.ndarray]] = [[] for _ in qid]
            for at, bins in expected(left, right):
                for i, row in enumerate(bins):
                    picked[i].append(at + np.flatnonzero(row >= cut[i]))
            for i in range(len(qid)):
                pick = np.concatenate(picked[i])
                s = inner(q[i], x[pick])
                best = np.lexsort((xid[pick], -s))
                # an id with several vectors of one product counts once
                ids, s = xid[pick][best], s[best]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])
                ids, s = ids[new][:k], s[new][:k]
                out[0].append(np.full(len(ids), qid[i]))
                out[1].append(ids)
                out[2].append(s)
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    def cells(queries: DataFrame, columns: list[str]):
        """Every chunk of queries with every block of rows."""
        left = queries.withColumn("qblock", each(blocks)).groupBy("qblock", "qchunk")
        return left.cogroup(data.select("block", *columns, each(chunks).alias("chunk")).groupBy("block", "chunk"))

    bins = cells(asks.select("qid", "qkey", "qo", "qchunk"), ["vid", "o", "size"]).applyInArrow(in_turn(counted), "qkey long, bin long, n long").groupBy("qkey", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("qkey").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    # the bin in which the wanted number is reached; the last one if there are fewer rows
    cuts = tmp.save(bins.withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0))).filter(F.col("before") < wanted).groupBy("qkey").agg(F.min("bin").alias("cut")))
    found = cells(asks.join(cuts, "qkey"), ["vid", "x", "o", "size"]).applyInArrow(in_turn(reranked), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
