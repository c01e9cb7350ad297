"""Centroid clustering by sort-means: exact k-means in whole numbers that skips centroids too far away to win.

Each round the other centroids are ordered by their distance from each centroid. A vector scans them in
the order of its previous centroid and stops at the first that is strictly beyond twice its distance to
that one: by the triangle inequality no such centroid, nor any after it, is as near.

Vectors are dealt out once, as blocks in buckets of a table. A round reads the blocks next to the bytes
that hold their previous centroids, one for a vector, in buckets of the same key, so no vector moves or
is written again. A round gives back its new bytes and sums per block and centroid; the driver sees the
sums of the centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Vectors of a block, and vectors of a bucket, about.
BLOCK = 8192
BUCKET = 500_000
#: Components up to here keep sums of squares exact in doubles; others are worked on as Python integers.
EXACT = 1 << 20
LONG = (1 << 63) - 1


def squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of the rows from one centroid, exact for either kind of array."""
    d = x - centroid
    return (d * d).sum(axis=1)


def sort_means(x: np.ndarray, centroids: list[list[int]], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroids, squared distances, distances computed); ties go to the smaller number.

    ``before`` holds each row's previous centroid, any number will do. Rows are whole numbers in
    doubles or Python integers in an object array.
    """
    small = x.dtype != object and max((abs(v) for c in centroids for v in c), default=0) <= EXACT
    c = np.array(centroids, dtype=np.float64 if small else object)
    x = x if small or x.dtype == object else whole(x)
    apart = [squares(c, c[a]) for a in range(len(c))]
    near, dist, work = before.astype(np.int64), np.zeros(len(x), dtype=c.dtype), 0
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        dist[rows] = squares(x[rows], c[a])
        work += len(rows)
        reach = 4 * dist[rows]
        for j in sorted((j for j in range(len(c)) if j != a), key=lambda j: (apart[a][j], j)):
            inside = reach >= apart[a][j]
            rows, reach = rows[inside], reach[inside]
            if not len(rows):
                break
            d = squares(x[rows], c[j])
            work += len(rows)
            wins = (d < dist[rows]) | ((d == dist[rows]) & (j < near[rows]))
            near[rows[wins]], dist[rows[wins]] = j, d[wins]
    return near, dist, work


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers in doubles as Python integers."""
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value): the number is the sum of value * 2**(32 * place); the values of many numbers may be added."""
    place = 0
    while total:
        low = total & 0xFFFFFFFF
        yield place, low
        total = (total - low) >> 32
        if total == -1:
            yield place + 1, -1
            return
        place += 1


def _blocks(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.float64) for b in column.to_pylist()]


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of ``dim`` finite components.

    Components x count as floor(scale * x). Centroids begin as the ``k`` vectors of smallest hex
    sha256 of ``seed:id``; of equal ids those of smaller components, vectors without an id last. A
    round assigns, squared distances and ties to the smaller number, and moves each centroid that has
    vectors to the floor of their mean. Rounds that change nothing are not repeated.

    Null vectors, vectors of another length and those with null or non-finite components are left
    out. Rows with a null id are clustered like others; repeated ids and rows are clustered each. With
    fewer than ``k`` vectors there are as many centroids; an empty table gives no rows. All numbers
    are exact at any size; a distance or an inertia that a long cannot hold is null. Extra columns
    are ignored.
    """
    if not 0 < k <= 255:
        raise ValueError("k must be 1 to 255")
    spark = table.sparkSession
    tmp = Scratch(spark, "sortmeans")
    vector = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    kept = table.filter(F.coalesce((F.size(vector) == dim) & F.forall(vector, finite), F.lit(False))).select(F.col(id_col).cast("long").alias("vid"), vector.alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vid").cast("string")), 256)
    # of vectors with one hash, those of smaller numbers; the numbers as strings of one width would not sort, arrays do
    first = kept.orderBy(order.asc_nulls_last(), F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v).cast("double"))).limit(k).collect()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[int(v) for v in np.floor(float(scale) * np.array(r.x))] for r in first]
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(kept.count() / bucket))

    def packed(batches):
        """Blocks of vectors: their ids, and their whole numbers in a row of bytes."""
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = np.floor(float(scale) * part.column(1).flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], type=pa.list_(pa.int64())), pa.array([x.tobytes()], type=pa.binary())], names=["ids", "x"])

    # one shuffle, of blocks; the number of a block comes from a written table, so that it stays the same when a task is run again
    loose = tmp.save(kept.mapInArrow(packed, "ids array<long>, x binary"))
    blocks = tmp.save_by(loose.withColumn("block", F.monotonically_increasing_id()).repartition(buckets, "block"), "block", buckets)
    tmp.drop(loose)

    def assigned(state: DataFrame | None) -> DataFrame:
        rows = blocks.select("block", "ids", "x")
        return rows.withColumn("before", F.lit(None).cast("binary")) if state is None else rows.join(state.select("block", F.col("near").alias("before")), "block")

    def scanned(batch: pa.RecordBatch, now: list[list[int]]):
        for x, before in zip(_blocks(batch.column(batch.schema.get_field_index("x"))), batch.column(batch.schema.get_field_index("before")).to_pylist(), strict=True):
            x = x.reshape(-1, dim)
            x = x if np.abs(x).max(initial=0) <= EXACT else whole(x)
            near, dist, _ = sort_means(x, now, np.zeros(len(x), np.int64) if before is None else np.frombuffer(before, np.uint8).astype(np.int64))
            yield x, near, dist

    def round_of(now: list[list[int]]):
        def run(batches):
            for batch in batches:
                for i, (x, near, _) in enumerate(scanned(batch, now)):
                    sums = []
                    for c in np.unique(near):
                        mine = x[near == c]
                        sums.append({"cluster": int(c), "n": len(mine), "sums": [str(int(v)) for v in mine.sum(axis=0)]})
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("block")).slice(i, 1), pa.array([near.astype(np.uint8).tobytes()], type=pa.binary()), pa.array([sums], type=pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])))], names=["block", "near", "parts"])

        return run

    def added(batches):
        """The parts of a task's blocks as one: (cluster, component, place, value); component ``dim`` counts vectors."""
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                for p in parts:
                    for d, v in enumerate([*p["sums"], p["n"]]):
                        total[p["cluster"], d] = total.get((p["cluster"], d), 0) + int(v)
        rows = [(c, d, place, v) for (c, d), t in total.items() for place, v in limbs(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "place", "value"])

    state = None
    for _ in range(rounds):
        before, state = state, tmp.save_by(assigned(state).mapInArrow(round_of(centroids), "block long, near binary, parts array<struct<cluster:int,n:long,sums:array<string>>>"), "block", buckets)
        if before is not None:
            tmp.drop(before)
        sums: dict[int, list[int]] = {}
        for r in state.select("parts").mapInArrow(added, "cluster int, component int, place int, value long").groupBy("cluster", "component", "place").agg(F.sum("value").alias("value")).collect():
            sums.setdefault(r["cluster"], [0] * (dim + 1))[r.component] += r.value << 32 * r.place
        after = [[v // sums[c][dim] for v in sums[c][:dim]] if c in sums else old for c, old in enumerate(centroids)]
        if after == centroids:
            break
        centroids = after

    def rows_of(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for i, (_, near, dist) in enumerate(scanned(batch, centroids)):
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1).flatten(), pa.array(near.astype(np.int32)), pa.array([int(v) if v <= LONG else None for v in dist], type=pa.int64())], names=["vec_id", "cluster", "distance"])

    final = tmp.save(assigned(state).mapInArrow(rows_of, "vec_id long, cluster int, distance long"))
    # try_sum is null beyond a long; a null distance makes its sum null
    whole_sum = lambda c: F.when(F.count("*") == F.count(c), F.try_sum(c))
    inertia = {r["cluster"]: r.inertia for r in final.groupBy("cluster").agg(whole_sum("distance").alias("inertia")).collect()}
    total = None if None in inertia.values() or sum(inertia.values()) > LONG else sum(inertia.values())
    named = [(c, v, total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in inertia.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return final.join(F.broadcast(about), "cluster").select(*[f.name for f in schema])
