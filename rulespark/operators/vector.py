"""Exact vector retrieval and its merge with keyword hits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keywords import best_of


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def topk(table: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` rows nearest to one query vector by cosine; ``TakeOrderedAndProject`` keeps k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return table.select(F.col(id_col), cosine(F.col(vector_col), q).alias("score")).filter("score is not null").orderBy(F.desc("score"), id_col).limit(k)


#: Query vectors of one pass over the table, and rows that are worked on at once.
QUERIES, SLICE = 8192, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in doubles; rows of zeros and of what is no number stay out by being not a number."""
    with np.errstate(all="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def topk_table(table: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_col: str, dim: int, limit: int = QUERIES) -> DataFrame:
    """(id, rank, id_col, score): for each query vector its ``k`` nearest rows by cosine, ties to the smaller id.

    ``queries`` has ``query_col``, its ids unique, and ``vector_col``; more than ``limit`` take several passes
    over the table. A task multiplies blocks and keeps k rows a query, so k rows a query and task are
    shuffled. Null and zero vectors, those of another length than ``dim`` and those with null or infinite
    components take no part on either side, nor do null ids.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    sound = lambda df, c: df.select(F.col(c).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter((F.size("x") == dim) & F.forall("x", finite) & F.exists("x", lambda v: v != 0) & F.col("id").isNotNull())
    rows, asked = sound(table, id_col), sound(queries, query_col)
    passes = max(1, -(-asked.count() // limit))
    kind, named = rows.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()

    def best_of_task(ids: list, q: np.ndarray):
        def run(batches):
            score, found = [np.zeros(0)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
            for b in batches:
                x = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                who = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(x), SLICE):
                    near = q @ x[at : at + SLICE].T
                    least = np.array([s[-1] if len(s) == k else -np.inf for s in score])
                    for i in np.flatnonzero((near >= least[:, None]).any(axis=1)):
                        some = np.flatnonzero(near[i] >= least[i])
                        s, w = np.concatenate([score[i], near[i][some]]), np.concatenate([found[i], who[at + some]])
                        by = np.lexsort((w, -s))[:k]
                        score[i], found[i] = s[by], w[by]
            flat = [x for i, s in zip(ids, score, strict=True) for x in [i] * len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(flat, type=pa.from_numpy_dtype(np.array(ids).dtype) if ids else pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["id", "row", "score"])

        return run

    parts = []
    for i in range(passes):
        mine = (asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)).collect()  # ``limit`` vectors, about
        q = _unit(np.array([r.x for r in mine]).reshape(-1, dim))
        parts.append(rows.mapInArrow(best_of_task([r.id for r in mine], q), f"id {named}, row {kind}, score double"))
    best = best_of(reduce(DataFrame.union, parts), [F.desc("score"), F.col("row")], k)
    return best.select("id", "rank", F.col("row").alias(id_col), "score")


# The columns of a table of vectors.
VECTOR_ROW = (
    "chunk_id string, content string, embedding array<float>, source_url string, source_type string, section_path string, headers array<string>, page_number bigint, title string, "
    "mime_type string, char_count bigint, word_count bigint, content_preview string, embedding_backend string, embedding_model string, inserted_at timestamp, metadata string, created_at timestamp"
)


def vector_rows(chunks: DataFrame, backend: str, model: str, now: Column | None = None) -> DataFrame:
    """Rows of a table of vectors from chunks (chunk_id, content, embedding and any of the other columns)."""
    now = F.current_timestamp() if now is None else now
    made = {
        "char_count": F.length("content"), "word_count": F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")), "content_preview": F.left("content", F.lit(200)),
        "embedding_backend": F.lit(backend), "embedding_model": F.lit(model), "inserted_at": now, "created_at": now,
    }
    fields = [f.split(" ", 1) for f in VECTOR_ROW.split(", ")]
    return chunks.select(*[(made[n] if n in made else F.col(n) if n in chunks.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, key: str) -> DataFrame:
    """Hits of both kinds once each, the vector's score first."""
    both = vector_hits.select(key, "score", F.lit(0).alias("kind")).unionByName(keyword_hits.select(key, F.col("score").cast("double").alias("score"), F.lit(1).alias("kind")))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("kind", F.desc("score")))).filter("_n = 1").drop("_n")
