"""NumPy kernels over Arrow text: packed bytes, word bounds, and 64-bit rolling fingerprints.

Every kernel works on whole texts. A batch is cut into slices of about ``SLICE_BYTES`` so the
temporaries stay small; one text is never cut, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: An odd multiplier has an inverse modulo 2**64, so a prefix sum gives any substring's hash.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer: spreads every input bit over the word."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 16_384) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a piece has about ``limit`` bytes of text and ``rows`` rows at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at, n = 0, batch.num_rows
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def lowered(buf: np.ndarray) -> np.ndarray:
    """A copy with the ASCII letters A-Z in lower case."""
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes when words are runs of anything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes when words are runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def letters(buf: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes belong to letters or digits: ``ALNUM`` without the punctuation outside ASCII.

    That is U+0080 to U+00BF but for the three letters there, U+00D7, U+00F7, U+2000 to U+206F,
    U+3000 to U+303F and U+FF00 to U+FF0F.
    """
    inside = ALNUM[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    lead = lead[lead + 1 < len(buf)]
    a, b = buf[lead], buf[lead + 1]
    two = lead[((a == 0xC2) & (b != 0xAA) & (b != 0xB5) & (b != 0xBA)) | ((a == 0xC3) & ((b == 0x97) | (b == 0xB7)))]
    inside[two] = inside[two + 1] = False
    rest = lead[((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)) | ((a == 0xEF) & (b == 0xBC))]
    rest = rest[rest + 2 < len(buf)]
    three = rest[(buf[rest] != 0xE2) | (buf[rest + 1] == 0x80) | (buf[rest + 2] < 0xB0)]
    three = three[(buf[three] != 0xEF) | (buf[three + 2] < 0x90)]
    inside[three] = inside[three + 1] = inside[three + 2] = False
    return inside


def word_bounds(buf: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of the words, and per text the index of its first word.

    Word bytes are those of ``table``, or by default ``letters``.
    """
    inside = letters(buf) if table is None else table[buf]
    edges = offs[(offs > 0) & (offs < len(buf))]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for ``spans_hash``; one longer than the bytes."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    down = powers(BASE_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(prefix(buf), starts, ends)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one sequence; empty if it is shorter."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for i in range(1, k):
        h *= U64(BASE)
        h += words[i : n + i]
    return mix(h)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence as one gram (an array of one value)."""
    h = words[:1].copy()
    for w in words[1:]:
        h = h * U64(BASE) + w
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, table: np.ndarray = NON_SPACE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles after ASCII lower-casing.

    Fewer than k words count as one shingle; a text without words has none.
    """
    buf = lowered(buf)
    starts, ends, first = word_bounds(buf, offs, table)
    words = word_hashes(buf, starts, ends)
    every = grams(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(sequence_hash(words[a:b]))
        else:
            out.append(words[:0])
    return out


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of NumPy arrays without making Python objects."""
    offs = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offs[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, type=kind))


class Lookup:
    """Which of many hashes are in a fixed set: a bitmap of the low bits first, then binary search."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.seen = np.zeros(1 << self.BITS, dtype=bool)
        self.seen[(self.keys & U64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, positions in keys) of the hits; the first key for keys that repeat."""
        at = np.flatnonzero(self.seen[(h & U64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        i = np.searchsorted(self.keys, h[at])
        i[i == len(self.keys)] = 0
        ok = self.keys[i] == h[at]
        return at[ok], i[ok]
