"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, the shapes of its words (runs of upper, lower, digit and other bytes,
punctuation as itself) and a few coarse bins of its form, each hashed to a column. A truncated
singular value decomposition of the weighted counts of a bounded sample of labelled rows gives the
latent space. The sample's vectors are broadcast; every text is compared with all of them in exact
blocked cosine products, and the labels of the nearest vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labelled import training_texts

#: Labelled rows of each class in the sample, at most; their vectors are broadcast.
SAMPLE_PER_CLASS = 2000
WORD_COLUMNS = 2048
SHAPE_COLUMNS = 1024
FORM_COLUMNS = 64
COLUMNS = WORD_COLUMNS + SHAPE_COLUMNS + FORM_COLUMNS
RANK = 48
#: Texts that are counted at once; each takes ``COLUMNS`` numbers.
ROWS = 512
NEIGHBOURS = 15
#: Weights of the three kinds of terms.
KIND_WEIGHTS = (0.5, 1.0, 1.0)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[48:58] = 48
_CLASS[128:] = 97


def _bin(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x)


def term_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """texts x COLUMNS: damped, length-free counts of terms, each kind of unit length."""
    texts = len(offs) - 1
    starts, ends, first = T.word_bounds(buf, offs, T.NON_SPACE)
    n_words = first[1:] - first[:-1]
    doc = np.repeat(np.arange(texts), n_words)
    words = T.word_hashes(T.lowered(buf), starts, ends)
    # shapes: one byte for each run of a class inside a word
    kind = _CLASS[buf]
    turn = np.ones(len(buf), dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    at = np.flatnonzero(turn & T.NON_SPACE[buf])
    short = kind[at]
    shapes = T.word_hashes(short, np.searchsorted(at, starts), np.searchsorted(at, ends))
    out = np.zeros((texts, COLUMNS), dtype=np.float32)

    def put(h: np.ndarray, width: int, base: int, weight: float) -> None:
        got = np.bincount(doc * width + (h % T.U64(width)).astype(np.int64), minlength=texts * width).reshape(texts, width)
        got = np.sqrt(got, dtype=np.float32)
        norm = np.sqrt((got * got).sum(axis=1, keepdims=True))
        out[:, base : base + width] = weight * got / np.maximum(norm, 1e-9)

    put(words, WORD_COLUMNS, 0, KIND_WEIGHTS[0])
    put(shapes, SHAPE_COLUMNS, WORD_COLUMNS, KIND_WEIGHTS[1])
    size = np.maximum(1, offs[1:] - offs[:-1])
    sums = lambda mask: (lambda s: s[offs[1:]] - s[offs[:-1]])(np.concatenate([[0], np.cumsum(mask)]))
    pairs = np.unique(doc.astype(T.U64) * T.U64(T.BASE) ^ words, return_index=True)[1] if len(doc) else np.zeros(0, np.int64)
    distinct = np.bincount(doc[pairs], minlength=texts)
    letters, upper = sums(kind == 97), sums((buf >= 65) & (buf < 91))
    forms = [
        _bin(n_words, [1, 5, 20, 50, 200, 1000, 5000]),
        _bin(distinct / np.maximum(1, n_words), [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]),
        _bin(upper / np.maximum(1, letters + upper), [0.01, 0.05, 0.1, 0.3, 0.6]),
        _bin((size - letters - upper) / size, [0.1, 0.2, 0.25, 0.3, 0.4, 0.6]),
        _bin((letters + upper) / np.maximum(1, n_words), [1, 2, 3, 4, 5, 6, 8, 12]),
    ]
    base = WORD_COLUMNS + SHAPE_COLUMNS
    for i, f in enumerate(forms):
        out[np.arange(texts), base + 12 * i + np.minimum(f, 11)] = KIND_WEIGHTS[2] / np.sqrt(len(forms))
    return out


@dataclass
class Model:
    weights: np.ndarray  # inverse frequency of each column
    axes: np.ndarray  # columns x rank
    vectors: np.ndarray  # sample x rank, of unit length
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = (counts * self.weights).astype(np.float64) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        texts = len(offs) - 1
        if not len(self.labels):
            return np.full(texts, self.prior)
        # rounded, so that the last bits, which depend on what else is in the slice, decide nothing
        like = np.round(self.latent(term_counts(buf, offs)) @ self.vectors.T, 9)
        k = min(NEIGHBOURS, like.shape[1])
        least = np.partition(like, like.shape[1] - k, axis=1)[:, like.shape[1] - k, None]
        over, even = like > least, like == least
        # of equal similarities the first of the sample count
        near = over | even & (np.cumsum(even, axis=1) <= k - over.sum(axis=1, keepdims=True))
        weight = np.maximum(like[near].reshape(texts, k), 0) ** 4 + 1e-9
        votes = np.broadcast_to(self.labels, like.shape)[near].reshape(texts, k)
        return np.round((weight * votes).sum(axis=1) / weight.sum(axis=1), 9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The space and its labelled vectors, from at most 2 * ``per_class`` rows outside the held-out fold.

    Without labelled rows every text scores 0.5.
    """
    sample = training_texts(docs, labels, "quality", per_class, id_col, text_col)

    def rows(batches):
        for part in T.slices(batches, rows=ROWS):
            counts = term_counts(*T.packed(part.column(1)))
            some = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), T.lists([s.astype(np.int32) for s in some], pa.int32()), T.lists([c[s] for c, s in zip(counts, some, strict=True)], pa.float32())], names=["did", "label", "at", "x"])

    got = sample.mapInArrow(rows, "did long, label int, at array<int>, x array<float>").toArrow().sort_by("did")
    y = got["label"].to_numpy().astype(np.float64)
    if not len(y):
        return Model(np.ones(COLUMNS, np.float32), np.zeros((COLUMNS, 1)), np.zeros((0, 1)), y, 0.5)
    x = np.zeros((len(y), COLUMNS), dtype=np.float32)
    for i, (at, v) in enumerate(zip(got["at"], got["x"], strict=True)):
        x[i, np.asarray(at.values)] = np.asarray(v.values)
    weights = (1 + np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0)))).astype(np.float32)
    # columns that nearly all texts have say little
    weighted = x * weights
    squares = weighted.T.astype(np.float64) @ weighted
    _, vectors = np.linalg.eigh(squares)
    axes = np.ascontiguousarray(vectors[:, ::-1][:, : min(RANK, len(y))])
    model = Model(weights, axes, np.zeros((0, 1)), y, float(y.mean()))
    model.vectors = np.ascontiguousarray(model.latent(x))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score) for every row; ``row`` is the whole input row.

    The score depends on the text alone: null is read as empty, and an empty text is compared like
    any other. Long texts are read whole. Repeated rows get equal scores; an empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # the bounded sample's vectors

    def run(batches):
        model = shared.value
        for part in T.slices(batches, rows=ROWS):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(*T.packed(part.column(1))).astype(np.float64))], names=["row", "score"])

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, score double")
