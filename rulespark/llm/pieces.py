"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut before every space into pre-tokens that start with the space mark; no merge of the
vocabulary crosses such a cut. In a pre-token the adjacent pair whose piece has the lowest id merges
first, taken from an agenda; a candidate merge is skipped for good if a keyed hash of (seed,
occurrence, place, piece) falls below the dropout rate. An occurrence is a pre-token's place in its
document, so each is cut by its own draws. All pre-tokens of a slice run their agendas at once, as
columns of arrays in which each step takes every column's first candidate; those of more than
``COLUMN`` characters run one by one with a heap. Characters without a piece, and space marks that
stand in the text, become bytes, so every segmentation decodes to the text it came from.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .vocabulary import SPACE, Vocabulary

DROPOUT = 0.1
SEED = 17
#: Characters of a pre-token that is worked on as a column; longer ones take the heap.
COLUMN = 64
#: Lengths of columns: a pre-token goes to the shortest that holds it.
LENGTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, COLUMN)
_M = (1 << 64) - 1
#: Symbols of a character without a piece, and of a place that was merged into one before.
BARE, GONE = -1, -2
#: No candidate merge.
NONE = np.int32(0x7FFFFFFF)


_PLACE, _PIECE = 0x165667B19E3779F9, 0x27D4EB2F165667C5


def lane(seed: int, occurrence: int) -> int:
    """The key of one occurrence."""
    h = (seed * 0x9E3779B97F4A7C15 + occurrence * 0xC2B2AE3D27D4EB4F + 1) & _M
    h ^= h >> 31
    return h * 0xFF51AFD7ED558CCD & _M


def lanes(seed: int, occurrences: np.ndarray) -> np.ndarray:
    """``lane`` of many occurrences."""
    h = occurrences * T.U64(0xC2B2AE3D27D4EB4F) + T.U64((seed * 0x9E3779B97F4A7C15 + 1) & _M)
    h ^= h >> T.U64(31)
    return h * T.U64(0xFF51AFD7ED558CCD)


def keyed(key: int, a: int, b: int, rank: int) -> int:
    """32 bits from the key of an occurrence and a candidate merge: its two places and the id of its piece."""
    h = (key + (a << 20 | b - a) * _PLACE + rank * _PIECE) & _M
    h ^= h >> 32
    h = h * 0xC4CEB9FE1A85EC53 & _M
    return (h ^ h >> 29) >> 32 & 0xFFFFFFFF


def keyed_many(keys: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``keyed`` of many occurrences."""
    h = keys + (a << 20 | b - a).astype(T.U64) * T.U64(_PLACE) + rank.astype(T.U64) * T.U64(_PIECE)
    h ^= h >> T.U64(32)
    h *= T.U64(0xC4CEB9FE1A85EC53)
    h ^= h >> T.U64(29)
    return h >> T.U64(32)


class Merges:
    """The vocabulary as arrays: the symbol of a code point, and the piece that two symbols make."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.count = vocabulary, len(vocabulary.pieces)
        symbols = dict(vocabulary.ranks)
        for n, c in enumerate(sorted({c for p in vocabulary.ranks for c in p} - symbols.keys())):
            symbols[c] = self.count + n
        # a space starts a pre-token; a space mark of the text has no piece and never merges
        self.symbol = np.full(0x110000, BARE, np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = s
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = symbols.get(SPACE, BARE), BARE
        made = {}
        for p, rank in vocabulary.ranks.items():
            for i in range(1, len(p)):
                if p[:i] in symbols and p[i:] in symbols:
                    made[symbols[p[:i]] << 32 | symbols[p[i:]]] = rank
        self.made = made
        self.bits = max(8, len(made).bit_length() + 2)
        self.keys = np.full((1 << self.bits) + 64, -(1 << 63), np.int64)
        self.ranks = np.full(len(self.keys), NONE, np.int32)
        keys = np.fromiter(made, np.int64, len(made))
        for key, rank, at in zip(keys.tolist(), made.values(), self._slot(keys).tolist(), strict=True):
            while self.ranks[at] != NONE:
                at += 1
            self.keys[at], self.ranks[at] = key, rank
        self.probes = 1 + max((int(np.flatnonzero(self.keys[at : at + 64] == key)[0]) for key, at in zip(keys.tolist(), self._slot(keys).tolist(), strict=True)), default=0)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(T.U64) * T.U64(T.BASE)) >> T.U64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the joined pieces, ``NONE`` where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.ranks[at], NONE)
        rest = np.flatnonzero((have != keys) & (have >= 0))
        for _ in range(1, self.probes):
            if not len(rest):
                break
            at[rest] += 1
            have = self.keys[at[rest]]
            hit = have == keys[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (have >= 0)]
        return out

    def columns(self, symbols: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """The symbols of many pre-tokens after their merges; ``symbols`` is places x pre-tokens, padded with ``BARE``."""
        length, n = symbols.shape
        edge = np.full((1, n), BARE, np.int32)
        now = np.concatenate([edge, symbols, edge])
        # per place the first candidate merge that starts there, as rank and place; rows 0 and length + 1 never have one
        agenda = np.full((length + 2, n), NONE, np.int32)
        ranks = self.find(now[1:-2].ravel(), now[2:-1].ravel()).reshape(length - 1, n)
        agenda[1:-2] = np.where(ranks == NONE, NONE, ranks << 7 | np.arange(1, length, dtype=np.int32)[:, None])
        following = np.repeat(np.arange(1, length + 3, dtype=np.int16)[:, None], n, axis=1)
        before = following - np.int16(2)
        done, which = now.copy(), np.arange(n)
        while True:
            first = agenda.min(axis=0)
            live = first != NONE
            left = np.count_nonzero(live)
            if left < 0.7 * len(first):
                done[:, which[~live]] = now[:, ~live]
                if not left:
                    return done[1:-1]
                # compress keeps rows contiguous, so the flat views below are views
                now, agenda, following, before = (x.compress(live, axis=1) for x in (now, agenda, following, before))
                which, keys, first = which[live], keys[live], first[live]
                at = np.arange(left)
            else:
                at = np.flatnonzero(live)
                first = first[at]
            width = now.shape[1]
            flat_now, flat_agenda, flat_next, flat_before = now.reshape(-1), agenda.reshape(-1), following.reshape(-1), before.reshape(-1)
            rank, a = first >> 7, (first & 127).astype(np.int64)
            here = a * width + at
            b = flat_next[here].astype(np.int64)
            flat_agenda[here] = NONE
            if limit:
                taken = keyed_many(keys[at], a - 1, b - 1, rank) >= T.U64(limit)
                at, rank, a, b, here = at[taken], rank[taken], a[taken], b[taken], here[taken]
            there = b * width + at
            c = flat_next[there].astype(np.int64)
            p = flat_before[here].astype(np.int64)
            flat_now[here], flat_now[there] = rank, GONE
            flat_agenda[there] = NONE
            flat_next[here] = c
            flat_before[c * width + at] = a
            more = self.find(rank, flat_now[c * width + at])
            flat_agenda[here] = np.where(more == NONE, NONE, more << 7 | a.astype(np.int32))
            there = p * width + at
            more = self.find(flat_now[there], rank)
            flat_agenda[there] = np.where(more == NONE, NONE, more << 7 | p.astype(np.int32))

    def heap(self, symbols: np.ndarray, key: int, limit: int) -> np.ndarray:
        """``columns`` for one pre-token of any length, in time n log n."""
        now = symbols.tolist()
        n = len(now)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.find(symbols[:-1], symbols[1:]).tolist()
        agenda = [(r, i, i + 1, now[i], now[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapify(agenda)

        def add(a: int, b: int) -> None:
            if (rank := self.made.get(now[a] << 32 | now[b])) is not None:
                heappush(agenda, (rank, a, b, now[a], now[b]))

        while agenda:
            rank, a, b, x, y = heappop(agenda)
            if right[a] != b or now[a] != x or now[b] != y:
                continue
            if limit and keyed(key, a, b, rank) < limit:
                continue
            now[a], now[b] = rank, GONE
            right[a] = c = right[b]
            right[b] = -2
            if c >= 0:
                left[c] = a
                add(a, c)
            if left[a] >= 0:
                add(left[a], a)
        return np.array(now, np.int32)

    def cut(self, texts: list[str], occurrence_keys: np.ndarray, dropout: float, seed: int) -> list[np.ndarray]:
        """The ids of each text under the draws of its occurrences, whose keys are given for each text."""
        limit = int(dropout * (1 << 32))
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        symbols = self.symbol[codes]
        starts = np.flatnonzero(codes == 32)
        lengths = np.diff(np.append(starts, len(codes)))
        text = np.searchsorted(ends, starts, side="right")
        place = np.arange(len(starts)) - np.searchsorted(starts, ends - sizes)[text]
        keys = lanes(seed, T.mix(occurrence_keys[text] + place.astype(T.U64)))
        low = 1
        for high in LENGTHS:
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if len(some):
                at = starts[some] + np.arange(high)[:, None]
                inside = np.arange(high)[:, None] < lengths[some]
                made = self.columns(np.where(inside, symbols[np.minimum(at, len(codes) - 1)], BARE), keys[some], limit)
                symbols[at[inside]] = made[inside]
        for i in np.flatnonzero(lengths > COLUMN).tolist():
            a, b = starts[i], starts[i] + lengths[i]
            symbols[a:b] = self.heap(symbols[a:b], int(keys[i]), limit)
        return self._ids(codes, symbols, ends)

    def _ids(self, codes: np.ndarray, symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The symbols that are left, characters without a piece as their bytes, cut by text."""
        kept = np.flatnonzero(symbols != GONE)
        ids = symbols[kept]
        bare = np.flatnonzero((ids < 0) | (ids >= self.count))
        total = np.ones(len(ids), np.int64)
        if len(bare):
            c = codes[kept[bare]]
            total[bare] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            ids = np.repeat(ids, total)
            data = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            first = (np.cumsum(total) - total)[bare]
            n = total[bare]
            at = np.repeat(first, n) + np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
            ids[at] = np.array(self.vocabulary.bytes_at, np.int32)[data]
        # codes before each text's end, then ids before it
        upto = np.concatenate([[0], np.cumsum(total)])[np.searchsorted(kept, ends)]
        return np.split(ids, upto[:-1]) if len(upto) else []


def decode(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of an encoded text; the mark that encoding put in front goes."""
    data = b"".join(map(table.__getitem__, ids.tolist()))
    return data[1:].decode("utf-8", "replace")


_kept: dict = {}


def merges_of(vocabulary: Vocabulary) -> Merges:
    """One a worker, made again if the vocabulary changes."""
    key = hash(vocabulary.pieces)
    if _kept.get("key") != key:
        _kept["key"], _kept["merges"] = key, Merges(vocabulary)
    return _kept["merges"]


def _encoder(shared, dropout: float, seed: int, with_ids: bool, digests: bool, lossless: bool):
    def run(batches):
        vocabulary: Vocabulary = shared.value
        table, merges = vocabulary.as_bytes(), merges_of(vocabulary)
        for part in T.slices(batches):
            keys = T.mix(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(T.U64) + T.U64(seed & _M))
            texts = part.column(2).to_pylist()
            arrays = merges.cut(texts, keys, dropout, seed)
            cols = {"row": part.column(0), "n_tokens": pa.array([len(a) for a in arrays], pa.int64())}
            if with_ids:
                cols["ids"] = T.lists(arrays, pa.int32())
            plain = [decode(a, table) if len(a) else "" for a in arrays] if digests or lossless else []
            if digests:
                cols["ids_sha256"] = pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a in arrays], pa.string())
                cols["decoded_sha256"] = pa.array([hashlib.sha256(p.encode()).hexdigest() for p in plain], pa.string())
            if lossless:
                cols["lossless"] = pa.array([p == (t or "") for p, t in zip(plain, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, decoded: bool = False) -> DataFrame:
    """(row, n_tokens, ids) for every row; ``row`` is the input row. ``decoded`` decodes again and adds ``lossless``.

    A null or empty text has no ids. The segmentation depends on seed, id and text only: repeated
    rows are cut alike, and a null id counts as -1. Texts of any length are encoded whole. Extra
    columns stay in ``row``; an empty table gives no rows. ``dropout`` 0 gives the model's own ids.
    """
    src = _source(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return src.mapInArrow(_encoder(shared, dropout, seed, True, False, decoded), f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, ids array<int>" + ", lossless boolean" * decoded)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256, lossless): ``encode`` then ``decode``, as digests."""
    src = _source(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return src.mapInArrow(_encoder(shared, dropout, seed, False, True, True), f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def decode_table(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(row, text) for every row of an encoded table; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        table = shared.value.as_bytes()
        for b in batches:
            cells = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(np.asarray(c.values), table) if c.is_valid else None for c in cells], pa.string())], names=["row", "text"])

    src = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, text string")
