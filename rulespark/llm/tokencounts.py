"""Token counts by dynamic programming over a trie of pre-tokens.

Pre-tokens are the parts of a text between spaces, each with the space mark in front. The best
segmentation of a pre-token under a unigram model (largest sum of piece scores, then fewest pieces)
has a forward score at every character, which depends on the prefix alone. So pre-tokens are inserted
in a trie that a worker keeps, as deep as ``DEEP``: a node holds the forward score of its prefix, worked out once from the
nodes above it, and a pre-token's last node holds its count of tokens. A text's count is the sum over
its pre-tokens. Characters without a piece cost one token for each byte. Scores may be given; without
any, the vocabulary's ranks stand for them, as its own model has none.
"""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .vocabulary import SPACE, Vocabulary

#: Nodes of the trie, and characters of the words whose counts a worker keeps; where full it starts anew, with equal results.
NODES, CHARS = 1_500_000, 24_000_000
#: Depth of the trie: what a pre-token has beyond is scored without nodes.
DEEP = 1024
#: Longer texts are counted in parts of about so many characters, cut at spaces.
PART = 1 << 20


def scores(vocabulary: Vocabulary) -> dict[str, float]:
    """Zipf log-probabilities: the piece of rank r has a share of 1 / (r + 1), up to the norm."""
    first = min(vocabulary.ranks.values())
    norm = math.log(sum(1 / (r - first + 1) for r in vocabulary.ranks.values()))
    return {p: -math.log(r - first + 1) - norm for p, r in vocabulary.ranks.items()}


class Trie:
    """Prefixes of the words met so far; a node is a place in the lists of its forward score and its fewest tokens."""

    def __init__(self, score: dict[str, float]):
        self.score = score
        # the last two characters say how long a piece that ends there can be
        lengths: dict[str, set[int]] = {}
        for p in score:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        self.back = {c: tuple(sorted(n)) for c, n in lengths.items()}
        self.unknown = min(score.values()) - 10.0
        self.longest = max(map(len, score))
        if self.longest > DEEP:
            raise ValueError(f"a piece of {self.longest} characters is longer than {DEEP}")
        #: Counts of whole pre-tokens, and the characters of those.
        self.terminal: dict[str, int] = {}
        self.chars = 0
        self.clear()

    def clear(self) -> None:
        """Forget the nodes; counts of words stay."""
        #: The child of node n by a character is at n * 2**21 + the character's code.
        self.child: dict[int, int] = {}
        self.best, self.less = array("d", [0.0]), array("i", [0])

    def insert(self, word: str) -> int:
        """The word's count of tokens; only prefixes that are new are scored."""
        child, best, less = self.child, self.best, self.less
        score_of, back = self.score.get, self.back.get
        path = [0]
        node = 0
        last = ""
        for end, c in enumerate(word[:DEEP], 1):
            key = node << 21 | ord(c)
            after = child.get(key)
            if after is None:
                s = score_of(c)
                if s is None:
                    size = len(c.encode())
                    top, few = best[node] + self.unknown * size, less[node] - size
                else:
                    top, few = best[node] + s, less[node] - 1
                for n in back(last + c, ()):
                    if n > end:
                        break
                    s = score_of(word[end - n : end])
                    if s is not None:
                        at = path[end - n]
                        s += best[at]
                        if s > top or s == top and less[at] - 1 > few:
                            top, few = s, less[at] - 1
                after = child[key] = len(best)
                best.append(top)
                less.append(few)
            node = after
            last = c
            path.append(node)
        if len(word) > DEEP:
            return self._beyond(word, path)
        self.terminal[word] = count = -less[node]
        self.chars += len(word)
        return count

    def _beyond(self, word: str, path: list[int]) -> int:
        """The count of a word longer than the trie is deep; of its scores only as many as the longest piece has characters are held."""
        score_of, back = self.score.get, self.back.get
        best = deque((self.best[n] for n in path[-self.longest :]), self.longest)
        less = deque((self.less[n] for n in path[-self.longest :]), self.longest)
        last = word[DEEP - 1]
        for end in range(DEEP + 1, len(word) + 1):
            c = word[end - 1]
            s = score_of(c)
            if s is None:
                size = len(c.encode())
                top, few = best[-1] + self.unknown * size, less[-1] - size
            else:
                top, few = best[-1] + s, less[-1] - 1
            for n in back(last + c, ()):
                s = score_of(word[end - n : end])
                if s is not None:
                    s += best[-n]
                    if s > top or s == top and less[-n] - 1 > few:
                        top, few = s, less[-n] - 1
            best.append(top)
            less.append(few)
            last = c
        return -less[-1]

    def count(self, split: list[list[str]]) -> list[int]:
        """The tokens of every list of words."""
        words = set().union(*split)
        deep = {}
        for w in words - self.terminal.keys():
            if len(self.best) > NODES:
                self.clear()
            n = self.insert(w)
            if len(w) > DEEP:
                deep[w] = n
        # words beyond the depth are known for these lists only
        self.terminal.update(deep)
        counts = [sum(map(self.terminal.__getitem__, ws)) for ws in split]
        for w in deep:
            del self.terminal[w]
        if self.chars > CHARS:
            self.terminal.clear()
            self.chars = 0
        return counts


def words(text: str) -> list[str]:
    return [SPACE + w for w in text.split(" ")]


def parts(text: str) -> Iterator[str]:
    """The text cut at spaces; the words of the parts are those of the text."""
    at = 0
    while (end := text.find(" ", at + PART)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


_kept: dict = {}


def _counter(shared):
    def run(batches):
        score = shared.value
        key = hash(tuple(score.items()))
        if _kept.get("key") != key:
            _kept["key"], _kept["trie"] = key, Trie(score)
        trie: Trie = _kept["trie"]
        for part in T.slices(batches):
            texts = part.column(1).to_pylist()
            if len(texts) == 1 and len(texts[0]) > PART:
                sizes, counts = [0], [0]
                for p in parts(texts[0]):
                    ws = words(p)
                    sizes[0] += len(ws)
                    counts[0] += trie.count([ws])[0]
            else:
                split = [words(t) if t else [] for t in texts]
                sizes, counts = [len(ws) for ws in split], trie.count(split)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["row", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, text_col: str = "text", model: str | None = None, piece_scores: dict[str, float] | None = None) -> DataFrame:
    """(row, n_pretokens, n_tokens) for every row; ``row`` is the input row.

    A null or empty text has none of either. Texts of any length count whole: a long text is counted in
    parts, a long text without spaces as one pre-token, whose scores beyond the trie's depth are not kept. Repeated rows count alike; an empty table gives no rows. ``piece_scores``
    are log-probabilities of pieces, with the space mark for a space.
    """
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores or scores(Vocabulary.load(model)))
    return src.mapInArrow(_counter(shared), f"row {src.schema['row'].dataType.simpleString()}, n_pretokens long, n_tokens long")
