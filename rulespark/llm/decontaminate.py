"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits; typographic quotes, dashes and the like part them. The running Karp-Rabin hashes of the items' runs
of ``MIN_MATCH`` tokens (the whole item, if it is shorter) are the join table. A tile consists of such
runs, so no tiling marks more of an item than its shared runs cover; a pair whose cover is below
``COVERAGE`` is left out. For each other pair the longest common runs of unmarked
tokens are marked again and again, longest first, until none has ``MIN_MATCH`` tokens, so passages
whose sentences were moved are still covered. The share of the item's tokens that is marked is its
coverage.
"""

from __future__ import annotations

import math
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

MIN_MATCH = 3
COVERAGE = 0.8
#: Places of shared runs that are sorted at once; one text's places are never cut.
PLACES = 2_000_000
#: Characters of benchmark text that are sent to the tasks at once; a larger benchmark takes several passes.
BROADCAST_CHARS = 16_000_000

TILE = "array<struct<item_start:int,doc_start:int,length:int>>"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each text)."""
    buf, offs = T.packed(pc.utf8_lower(column))
    starts, ends, first = T.word_bounds(buf, offs)
    return T.word_hashes(buf, starts, ends), first


def common_runs(doc: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Rows (length, item start, text start) of the maximal common runs of ``k`` tokens or more, longest first, then leftmost.

    Places that share a run of k tokens are looked at ``PLACES`` at a time and joined along their
    diagonals, so that what is held is the runs, not their places.
    """
    keys = T.grams(item, k)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    grams = T.grams(doc, k)
    low, high = np.searchsorted(keys, grams, side="left"), np.searchsorted(keys, grams, side="right")
    at = np.flatnonzero(high > low)
    many = (high - low)[at]
    total = np.cumsum(many)
    found = np.zeros((0, 3), np.int64)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PLACES, side="right")))
        n = many[a:b]
        d = np.repeat(at[a:b], n)
        i = order[np.repeat(low[at[a:b]], n) + np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)]
        # (diagonal, first text place, places) of what is known and of what is new
        part = np.column_stack([d - i, d, np.ones(len(d), np.int64)])
        part = np.concatenate([found, part]) if len(found) else part
        part = part[np.lexsort((part[:, 1], part[:, 0]))]
        new = np.ones(len(part), bool)
        new[1:] = (part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1] + part[:-1, 2])
        first = np.flatnonzero(new)
        found = np.column_stack([part[first, :2], np.add.reduceat(part[:, 2], first)])
        a = b
    runs = np.column_stack([found[:, 2] + k - 1, found[:, 1] - found[:, 0], found[:, 1]])
    return runs[np.lexsort((runs[:, 2], runs[:, 1], -runs[:, 0]))]


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of the tiles of one pair, longest first, then leftmost."""
    min_match = max(1, min(min_match, len(item)))
    runs = common_runs(doc, item, min_match)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    left = len(item)
    tiles = []
    parts: list[tuple[int, int, int]] = []  # what is left of runs that were cut into
    at = 0
    while left >= min_match and (at < len(runs) or parts):
        whole = (-int(runs[at, 0]), int(runs[at, 1]), int(runs[at, 2])) if at < len(runs) else None
        if whole is not None and not (parts and parts[0] < whole):
            n, i, d = whole
            at += 1
        else:
            n, i, d = heappop(parts)
        n = -n
        free = free_item[i : i + n] & free_doc[d : d + n]
        if free.all():
            tiles.append((i, d, n))
            free_item[i : i + n] = free_doc[d : d + n] = False
            left -= n
        elif free.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= min_match:
                    heappush(parts, (a - b, i + a, d + a))
    return tiles


def _covered(doc: np.ndarray, at: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, tokens) that runs of k tokens from places ``at`` of the joined items cover; rows may repeat."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    item = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    size = np.full(len(at), k)
    size[:-1] = np.where(new[1:], k, np.minimum(k, at[1:] - at[:-1]))
    first = np.flatnonzero(new)
    return doc[first], item[first], np.add.reduceat(size, first)


def _pairs(items: list[tuple[int, str]], min_match: int, coverage: float):
    flat, bounds = tokens(pa.array([t for _, t in items], pa.string()))
    lengths = np.diff(bounds)
    parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    owner = np.repeat(np.arange(len(parts)), lengths)
    # each run length needs its own pass over the grams: min_match, and shorter ones for shorter items
    run_length = np.minimum(max(1, min_match), lengths)
    tables = {}
    for k in np.unique(run_length[lengths > 0]).tolist():
        g = T.grams(flat, k)
        of = owner[: len(g)]
        places = np.flatnonzero((run_length[of] == k) & (np.arange(len(g)) + k <= bounds[1:][of]))
        keys = g[places]
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        one, start = np.unique(keys, return_index=True)
        tables[k] = (T.Lookup(one), start, np.append(start[1:], len(keys)), places)

    def pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(token hashes, first token of each text, the pairs of text and item whose shared runs may reach the coverage)."""
        words, first = tokens(column)
        ends = first[1:]
        found: list[tuple[int, int]] = []
        for k, (lookup, low, high, places) in tables.items():
            at, key = lookup.find(T.grams(words, k))
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + k <= ends[doc]
            shared = np.unique(doc[inside] * len(low) + key[inside])
            doc, key = shared // len(low), shared % len(low)
            many = high[key] - low[key]
            # whole texts, about PLACES places at a time
            total = np.cumsum(many)
            a = 0
            while a < len(doc):
                b = int(np.searchsorted(total, (total[a - 1] if a else 0) + PLACES, side="right"))
                b = int(np.searchsorted(doc, doc[max(a, b - 1)], side="right"))
                n = many[a:b]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d, i, covered = _covered(np.repeat(doc[a:b], n), places[np.repeat(low[key[a:b]], n) + step], owner, k)
                enough = covered >= coverage * lengths[i] - 1e-9
                found.extend(zip(d[enough].tolist(), i[enough].tolist(), strict=True))
                a = b
        return words, first, sorted(found)

    def judged(column: pa.Array):
        """(text, item, matched tokens, tiles) of each pair that reaches the coverage."""
        words, first, found = pairs_of(column)
        for d, n in found:
            tiles = tile(words[first[d] : first[d + 1]], parts[n], min_match)
            matched = sum(t[2] for t in tiles)
            if matched >= coverage * len(parts[n]) - 1e-9:
                yield d, n, matched, tiles

    def run(batches):
        for part in T.slices(batches):
            rows = [(d, items[n][0], len(parts[n]), matched, [{"item_start": i, "doc_start": j, "length": k} for i, j, k in tiles]) for d, n, matched, tiles in judged(part.column(1))]
            if rows:
                cols = list(zip(*rows, strict=True))
                kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array([m / n for m, n in zip(cols[3], cols[2], strict=True)], pa.float64()), pa.array(cols[4], kind)],
                    names=["doc_id", "item_id", "item_tokens", "matched_tokens", "coverage", "tiles"],
                )

    def clean(batches):
        for part in T.slices(batches):
            keep = np.ones(part.num_rows, bool)
            keep[[d for d, *_ in judged(part.column(1))]] = False
            if keep.any():
                yield part.filter(pa.array(keep))

    return run, clean


def _passes(benchmark: DataFrame, item_col: str, item_text: str):
    """The items with text, as lists of at most about ``BROADCAST_CHARS`` characters (one list almost always)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("length(text) > 0")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = math.ceil(size / BROADCAST_CHARS)
    for i in range(passes):
        mine = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        yield [(r.item_id, r.text) for r in mine.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched_tokens, coverage, tiles) of every pair that reaches ``coverage``.

    Null or tokenless texts and items match nothing; null ids stay null in the result. Repeated rows
    are judged row by row. Items of any length are matched whole. Extra columns are ignored; an empty
    table on either side gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = f"doc_id long, item_id long, item_tokens int, matched_tokens int, coverage double, tiles {TILE}"
    found = [src.mapInArrow(_pairs(rows, min_match, coverage)[0], kind) for rows in _passes(benchmark, item_col, item_text)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that reach ``coverage`` of no item, each judged by its own text.

    Ids play no part: rows without one, or that share one, are kept or dropped each. Null or tokenless
    texts are kept; so is everything if the benchmark is empty. All columns stay as they are.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = out.schema
    for rows in _passes(benchmark, item_col, item_text):
        # the text is the second column here
        out = out.mapInArrow(_pairs(rows, min_match, coverage)[1], schema)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
