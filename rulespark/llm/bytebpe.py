"""Byte-level BPE: pre-tokens by scans of transition functions, slices into cached pair merging, offsets kept.

Characters become symbols: their class, and for white space and apostrophes what follows them. A small
automaton over the symbols says where pre-tokens begin. Each symbol is a function from state to state;
composing such functions is associative and they generate a small finite set, so that all states of a
slice come from one prefix scan with a composition table, over lanes side by side. No regular expression
runs.

The pre-tokens of a slice are grouped by hash, checked byte by byte against the first of their group,
and only those that the worker has not seen are merged: short ones side by side, a merge each a round;
long ones rank by rank over linked positions. Each token keeps the byte offset at which it begins, and
decoding writes its bytes there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens beyond so many bytes are merged one by one and not remembered.
SHORT = 64
#: Bytes of pre-tokens a worker remembers, and pre-tokens.
CACHE_BYTES, CACHE_WORDS = 16 << 20, 400_000
#: Symbols of a lane in a scan.
LANE = 64
NONE = np.int32(2**31 - 1)

LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(6)
#: Symbols: letter, number, other, an apostrophe that begins a contraction of one or two letters, a space
#: before something, other white space before something, white space before more of it or the end.
SYMBOLS = 8
L, N, O, Q1, Q2, JOINED, SINGLE, RUN = range(SYMBOLS)
#: States: a pre-token begins; in letters, numbers, others; after a joined space; in white space; one or two letters of a contraction to go.
STATES = 8
BEGIN, IN_L, IN_N, IN_O, AFTER_SPACE, IN_RUN, ONE_LEFT, TWO_LEFT = range(STATES)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins) by symbol and state; symbols from SYMBOLS on are first in their text."""
    after, begins = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.zeros((2 * SYMBOLS, STATES), bool)
    for state in range(STATES):
        for symbol, own in ((L, IN_L), (N, IN_N), (O, IN_O), (Q1, IN_O), (Q2, IN_O)):
            goes_on = state in (own, AFTER_SPACE)
            after[symbol, state], begins[symbol, state] = own, not goes_on
            if symbol in (Q1, Q2) and not goes_on:
                after[symbol, state] = ONE_LEFT if symbol == Q1 else TWO_LEFT
        if state in (ONE_LEFT, TWO_LEFT):
            after[L, state], begins[L, state] = (BEGIN, ONE_LEFT)[state == TWO_LEFT], False
        after[JOINED, state], begins[JOINED, state] = AFTER_SPACE, True
        after[SINGLE, state], begins[SINGLE, state] = BEGIN, True
        after[RUN, state], begins[RUN, state] = IN_RUN, state != IN_RUN
    after[SYMBOLS:], begins[SYMBOLS:] = after[:SYMBOLS, [BEGIN]], True
    return after, begins


def _closed(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(functions, table): all compositions of the symbols' functions, theirs first and then the identity; table[f, g] is g after f."""
    found = [tuple(row) for row in after.tolist()]
    number = {}
    functions = []
    for f in [*found, tuple(range(STATES))]:
        number.setdefault(f, len(functions))
        functions.append(f)
    at = 0
    while at < len(functions):
        f = functions[at]
        for g in found:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
        at += 1
    table = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return np.array(functions, np.uint8), table


AFTER, BEGINS = _automaton()
FUNCTIONS, COMPOSED = _closed(AFTER)
IDENTITY = 2 * SYMBOLS


def composed_before(functions: np.ndarray) -> np.ndarray:
    """For each place the composition of all functions before it: lanes side by side, then the lanes' wholes in the same way."""
    n = len(functions)
    if n <= 1:
        return np.full(n, IDENTITY, np.uint16)
    lanes = -(-n // LANE)
    padded = np.full(lanes * LANE, IDENTITY, np.uint16)
    padded[:n] = functions
    steps = padded.reshape(lanes, LANE).T.copy()
    before = np.empty_like(steps)
    now = np.full(lanes, IDENTITY, np.uint16)
    for j in range(LANE):
        before[j] = now
        now = COMPOSED[now, steps[j]]
    return COMPOSED[composed_before(now)[None, :], before].T.reshape(-1)[:n]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their first bytes) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    codes = lead.astype(np.uint32)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        some = np.flatnonzero((lead >= low) & (lead < high))
        code = (lead[some] & (0xFF >> size + 1)).astype(np.uint32)
        for i in range(1, size):
            code = code << 6 | (buf[at[some] + i] & 0x3F)
        codes[some] = code
    return codes, at


def begins_at(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token. ``first``: the index of each text's first character, and the end."""
    kind = classes[codes]
    n = len(codes)
    texts = first[:-1][first[:-1] < first[1:]]
    last = np.zeros(n, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    blank = (kind == SPACE) | (kind == BLANK)
    more = np.ones(n, bool)
    more[:-1] = blank[1:]
    more |= last
    symbol = np.array([L, N, O, JOINED, SINGLE, O], np.uint8)[kind]
    symbol[blank & more] = RUN
    quotes = np.flatnonzero((kind == QUOTE) & ~last)
    if len(quotes):
        one = codes[quotes + 1]
        symbol[quotes[np.isin(one, np.frombuffer(b"stmd", np.uint8))]] = Q1
        longer = ~last[quotes + 1]
        quotes, one = quotes[longer], one[longer]
        two = codes[quotes + 2]
        symbol[quotes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = Q2
    symbol[texts] += SYMBOLS
    return BEGINS[symbol, FUNCTIONS[composed_before(symbol), BEGIN]]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, asked of the library whose cuts are to be met, once on the driver."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        of = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(of.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[32], table[39] = SPACE, QUOTE
    return table


@dataclass(frozen=True)
class Ranks:
    """A vocabulary as arrays: what the tasks need, of a size that the file fixes."""

    data: np.ndarray  # the tokens' bytes, one after the other
    starts: np.ndarray  # where each begins, and the end
    byte: np.ndarray  # the ids of single bytes
    keys: np.ndarray  # pairs of ids that merge, hashed into slots; the id that they make
    made: np.ndarray
    classes: np.ndarray

    @classmethod
    def load(cls, path: str | None = None) -> Ranks:
        """A file of lines "base64 rank". Every byte must have a rank, and ranks run from 0 without a gap."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls.of(ranks)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Ranks:
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must run from 0 without a gap and cover every byte")
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, made = hashed(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32))
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)]), np.array([ranks[bytes([b])] for b in range(256)], np.int32), keys, made, classes())


FREE = np.uint64(2**64 - 1)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (T.mix(keys) & np.uint64(size - 1)).astype(np.int64)


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of an open table with linear probing, a quarter full at most."""
    size = 1 << max(4, (4 * len(keys) - 1).bit_length())
    slots, held = np.full(size, FREE, np.uint64), np.full(size, NONE, np.int32)
    at, left = _slot(keys, size), np.arange(len(keys))
    while len(left):
        free = left[slots[at[left]] == FREE]
        _, one = np.unique(at[free], return_index=True)
        put = free[one]
        slots[at[put]], held[at[put]] = keys[put], values[put]
        left = np.setdiff1d(left, put)
        at[left] = (at[left] + 1) & (size - 1)
    return slots, held


class Merges:
    """Cuts pre-tokens into ids, and remembers those it has cut."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.held = 0
        data, starts = ranks.data.tobytes(), ranks.starts.tolist()
        self.whole = {data[a:b]: i for i, (a, b) in enumerate(zip(starts[:-1], starts[1:]))}

    def makes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, or NONE."""
        keys, made = self.ranks.keys, self.ranks.made
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = _slot(pair, len(keys))
        got = keys[at]
        out = np.where(got == pair, made[at], NONE)
        look = np.flatnonzero((got != pair) & (got != FREE))
        while len(look):
            at[look] = (at[look] + 1) & (len(keys) - 1)
            got = keys[at[look]]
            hit = got == pair[look]
            out[look[hit]] = made[at[look[hit]]]
            look = look[~hit & (got != FREE)]
        return out

    def short(self, words: list[bytes]) -> list[np.ndarray]:
        """Many short pre-tokens side by side: a round merges in each its leftmost pair of least rank."""
        data = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.ranks.byte[data]
        pair = np.full(len(ids), NONE, np.int32)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pair[same] = self.makes(ids[same], ids[same + 1])
        done_ids, done_owner = [], []
        while len(ids):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(pair, start)
            sizes = np.diff(np.append(start, len(ids)))
            each = np.repeat(least, sizes)
            over = each == NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, pair, each = ids[~over], owner[~over], pair[~over], each[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(pair == each)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            ids[at] = pair[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, owner, pair = ids[keep], owner[keep], pair[keep]
            look = np.concatenate([at, at[at > 0] - 1])
            inside = look < len(ids) - 1
            pair[look[~inside]] = NONE
            look = look[inside]
            near = owner[look] == owner[look + 1]
            pair[look[~near]] = NONE
            look = look[near]
            pair[look] = self.makes(ids[look], ids[look + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        by = np.argsort(owner, kind="stable")
        return np.split(ids[by], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def long(self, word: bytes) -> np.ndarray:
        """One long pre-token: ranks in rising order, all places of a rank at once, in memory of a few numbers a byte.

        That is the order of single merges as long as no merge makes a pair of a lower rank; should one
        do so, the merges are done one by one.
        """
        ids = self.ranks.byte[np.frombuffer(word, np.uint8)].copy()
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n, NONE, np.int32)
        pair[:-1] = self.makes(ids[:-1], ids[1:])
        waiting: dict[int, list[np.ndarray]] = {}

        def wait(at: np.ndarray) -> None:
            at = at[pair[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(pair[at], kind="stable")]
            ranks, first = np.unique(pair[at], return_index=True)
            for r, some in zip(ranks.tolist(), np.split(at, first[1:]), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(some)

        queue: list[int] = []
        wait(np.arange(n - 1))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            # of places in a row, where each pair shares a token with the next, every other one
            joined = np.append(False, after[at[:-1]] == at[1:])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
            gone = after[at]
            ids[at] = rank
            pair[gone] = NONE
            ids[gone] = -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            pair[at] = NONE
            pair[at[inner]] = self.makes(ids[at[inner]], ids[after[at[inner]]])
            back = before[at]
            back = back[back >= 0]
            pair[back] = self.makes(ids[back], ids[after[back]])
            new = np.unique(np.concatenate([at, back]))
            if (pair[new] < rank).any():
                return self.single(word)
            wait(new)
        return ids[ids >= 0]

    def single(self, word: bytes) -> np.ndarray:
        """The merges one by one, least rank first and then leftmost."""
        ids = self.ranks.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.makes(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        queue = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(queue)
        while queue:
            rank, i, x, y = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((i, after[i]), (before[i], i)):
                if a >= 0 and b < n and (r := int(self.makes(np.array([ids[a]]), np.array([ids[b]]))[0])) != NONE:
                    heapq.heappush(queue, (r, a, ids[a], ids[b]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def cut(self, words: list[bytes]) -> list:
        """The ids of each of some different pre-tokens; one that is a token is that token."""
        known = self.known
        out = [known.get(w) for w in words]
        new = [i for i, ids in enumerate(out) if ids is None]
        if self.held > CACHE_BYTES or len(known) > CACHE_WORDS:
            known.clear()
            self.held = 0
        merge = []
        for i in new:
            if (whole := self.whole.get(words[i])) is not None:
                out[i] = known[words[i]] = (whole,)
            elif len(words[i]) > SHORT:
                out[i] = self.long(words[i])
            else:
                merge.append(i)
        if merge:
            for i, ids in zip(merge, self.short([words[i] for i in merge]), strict=True):
                out[i] = known[words[i]] = tuple(ids.tolist())
                self.held += len(words[i])
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the byte at which each token begins, index of each text's first token and the end) of some texts."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        codes, at = code_points(buf)
        starts = at[begins_at(codes, np.searchsorted(at, offs), self.ranks.classes)]
        ends = np.append(starts[1:], len(buf))
        size = ends - starts
        _, first, group = np.unique(T.spans_hash(T.prefix(buf), starts, ends), return_index=True, return_inverse=True)
        # pre-tokens fill the texts, so one comparison shows that all of a group are the same bytes
        like = first[group]
        if (size != size[like]).any() or (buf[np.repeat(starts[like] - starts, size) + np.arange(len(buf))] != buf).any():
            number: dict[bytes, int] = {}
            group = np.array([number.setdefault(buf[a:b].tobytes(), len(number)) for a, b in zip(starts.tolist(), ends.tolist())])
            first = np.unique(group, return_index=True)[1]
        data = buf.tobytes()
        ids = self.cut([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.asarray(i, np.int32) for i in ids]) if count.max() > 1 else np.array([i[0] for i in ids], np.int32)
        low = np.cumsum(count) - count
        many = count[group]
        step = np.cumsum(many)
        out = flat[np.repeat(low[group] - (step - many), many) + np.arange(step[-1])]
        width = np.diff(self.ranks.starts)[out]
        begin = np.cumsum(width) - width
        return out, begin, np.searchsorted(begin, offs)

    def decode(self, ids: np.ndarray, begin: np.ndarray | None = None) -> bytes:
        """The bytes of the tokens; ``begin`` says where each one's belong, by default one after the other."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.ranks.starts) - 1:
            raise ValueError("an id is not in the vocabulary")
        width = np.diff(self.ranks.starts)[ids]
        begin = np.cumsum(width) - width if begin is None else begin - begin[0]
        out = np.zeros(int((begin + width).max()), np.uint8)
        inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        out[np.repeat(begin, width) + inside] = self.ranks.data[np.repeat(self.ranks.starts[ids], width) + inside]
        return out.tobytes()


_kept: dict = {}


def merges_of(ranks: Ranks) -> Merges:
    """One a worker, made again if the vocabulary changes."""
    key = hashlib.sha256(ranks.data.tobytes() + ranks.starts.tobytes()).digest()
    if _kept.get("key") != key:
        _kept["key"], _kept["merges"] = key, Merges(ranks)
    return _kept["merges"]


def parts(buf: np.ndarray, limit: int = T.SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about ``limit`` bytes of one text, cut before a space or line break after something else.

    A pre-token always begins there and nothing before it looks further, so parts are cut like the
    whole. Only a text without such a place is one part.
    """
    if len(buf) <= limit:
        yield 0, len(buf)
        return
    gap = (buf == 32) | (buf == 10)
    # anything but white space stands before: of ASCII, as other spaces are longer in UTF-8
    solid = (buf > 32) & (buf < 127)
    places = np.flatnonzero(gap[1:] & solid[:-1]) + 1
    a = 0
    while a < len(buf):
        i = np.searchsorted(places, a + limit)
        b = int(places[i]) if i < len(places) else len(buf)
        yield a, b
        a = b


def _encoder(shared, arrays: bool, digests: bool, limit: int):
    def run(batches):
        merges = merges_of(shared.value)
        for batch in T.slices(batches, limit=limit):
            buf, offs = T.packed(batch.column(1))
            n, rows = batch.num_rows, range(batch.num_rows)
            total = np.zeros(n, np.int64)
            ids: list[list[np.ndarray]] = [[] for _ in rows]
            begin: list[list[np.ndarray]] = [[] for _ in rows]
            hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in rows] if digests else []
            # a text beyond the limit is alone in its batch
            for a, b in parts(buf, limit) if n == 1 else [(0, len(buf))]:
                got, where, first = merges.encode(buf[a:b], np.array([0, b - a]) if n == 1 else offs)
                raw = got.astype("<u4")
                for i in rows:
                    some = slice(first[i], first[i + 1])
                    total[i] += first[i + 1] - first[i]
                    if arrays:
                        ids[i].append(got[some])
                        begin[i].append(where[some] + a - offs[i])
                    if digests:
                        hashes[i][0].update(raw[some].tobytes())
                        hashes[i][1].update(merges.decode(got[some], where[some]))
            cols = {"row": batch.column(0), "n_tokens": pa.array(total)}
            if arrays:
                cols["ids"] = T.lists([np.concatenate(x) for x in ids], pa.int32())
                cols["offsets"] = T.lists([np.concatenate(x) for x in begin], pa.int64())
            if digests:
                cols["ids_sha256"] = pa.array([x.hexdigest() for x, _ in hashes], pa.string())
                cols["decoded_sha256"] = pa.array([x.hexdigest() for _, x in hashes], pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _source(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = T.SLICE_BYTES) -> DataFrame:
    """(row, n_tokens, ids, offsets) for every row; ``row`` is the input row, offsets are the bytes at which tokens begin.

    Ids are those of the library for this file of ranks, without special tokens. A null or empty
    text has none. Bytes that are not UTF-8 count as U+FFFD. Texts of any length are encoded whole, in
    parts of about ``limit`` bytes cut where a pre-token begins. Repeated rows and null ids are
    encoded each; extra columns stay in ``row``; an empty table gives no rows.
    """
    src = _source(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path))
    return src.mapInArrow(_encoder(shared, True, False, limit), f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, ids array<int>, offsets array<long>")


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = T.SLICE_BYTES) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256): ``encode`` then ``decode``, as digests; ids and bytes are never held whole."""
    src = _source(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path))
    return src.mapInArrow(_encoder(shared, False, True, limit), f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_table(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(row, data) for every row of an encoded table: the bytes of its ids. Null ids, null items and ids outside the vocabulary give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Ranks.load(path))

    def run(batches):
        merges = merges_of(shared.value)
        top = len(shared.value.starts) - 1

        def plain(cell) -> bytes | None:
            if not cell.is_valid or cell.values.null_count:
                return None
            ids = np.asarray(cell.values)
            return None if len(ids) and (ids.min() < 0 or ids.max() >= top) else merges.decode(ids)

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([plain(c) for c in b.column(1)], pa.binary())], names=["row", "data"])

    src = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, data binary")
