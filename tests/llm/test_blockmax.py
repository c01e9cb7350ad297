"""Block-Max WAND against scoring every document."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulespark.llm import blockmax

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


def key(r):
    return tuple((v is not None, v or 0) for v in r)


def check(spark, docs, items, k=3, chars=blockmax.PASS_CHARS, first_segments=blockmax.FIRST_SEGMENTS, wave=1, **how):
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, score int")
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, rank int")
    got = blockmax.search(blockmax.build(d, **how), i, k=k, chars=chars, first_segments=first_segments, wave=wave)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items, k), key=key)


@pytest.mark.parametrize("block, segment, firsts", [(1, 50, 64), (4, 400, 2), (64, 1 << 20, 64)])
def test_equals_scoring_every_document(spark, block, segment, firsts):
    rng = np.random.default_rng(block)
    words = [f"w{i}" for i in range(40)] + ["Ä", "ñandú", "W3", "日本"]
    some = lambda n: " ".join(words[int(i)] for i in np.minimum(rng.zipf(1.4, n) - 1, len(words) - 1))
    docs = [(int(i), some(int(rng.integers(1, 40)))) for i in rng.permutation(300)]
    docs += [(5, "w1 w1"), (5, "w1 w1"), (5, "other"), (None, "w1 w2"), (None, "w1 w2"), (400, None), (401, ""), (402, "... !"), (403, "w7 " * 3000)]
    items = [(i, some(int(rng.integers(1, 12)))) for i in range(30)] + [(3, "w5 ñandú"), (None, "w1"), (90, None), (91, ""), (92, "-"), (93, "nowhere"), (94, "w1 w1 W1")]
    check(spark, docs, items, block=block, segment_bytes=segment, first_segments=firsts, chars=100 if block == 4 else 10**6)


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None), (2, "")], [(1, "a")])
    # held by all of many documents, a term weighs nothing
    check(spark, [(i, "a") for i in range(1200)], [(1, "a")])


def test_an_index_can_be_kept(spark, tmp_path):
    docs, items = [(i, f"a{i % 3} b{i % 5}") for i in range(50)], [(1, "a1 b2")]
    blockmax.build(spark.createDataFrame(docs, "doc_id long, text string"), path=f"file://{tmp_path}/i")
    got = blockmax.search(blockmax.opened(spark, f"file://{tmp_path}/i"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(tuple, got.collect())) == plain(docs, items, 4)


def segment(docs, block):
    import pyarrow as pa

    buf, offs = blockmax.T.packed(pa.array([t for _, t in docs]))
    a, b, first = blockmax.terms_of(buf, offs)
    held = np.diff(first)
    n, total = len(docs), int(held.sum())
    row = blockmax.segment_of(pa.array([d for d, _ in docs]), held, a, b, np.repeat(np.arange(n), held), blockmax.penalty(held, n, total), block)
    return blockmax.Segment(row, n, total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=12), min_size=1, max_size=60), st.lists(st.integers(0, 6), min_size=1, max_size=5, unique=True), st.integers(1, 5), st.integers(1, 7))
def test_any_segment(docs, query, k, block):
    docs = [(i, " ".join(f"t{w}" for w in d)) for i, d in enumerate(docs)]
    s = segment(docs, block)
    q = blockmax._questions([(1, " ".join(f"t{w}" for w in query))])
    where = s.lists(q.key, q.key2)
    held = Counter(w for _, t in docs for w in set(t.split()))
    some = np.flatnonzero(where >= 0)
    weights = np.array([blockmax.weight(len(docs), int(s.list_docs[i])) for i in where[some]], np.int64)
    best = blockmax.Best(k)
    if len(some) and (weights > 0).any():
        s.search(where[some][weights > 0], weights[weights > 0], best, wave=1)
    assert [(int(d), int(x)) for d, x in zip(best.doc, best.score)] == [(d, x) for _, _, d, x in plain(docs, [(1, " ".join(f"t{w}" for w in query))], k)]
    assert sum(held.values()) == s.count.sum()


def test_blocks_below_the_threshold_stay_packed():
    docs = [(i, "common " + "filler " * (i % 7 + 5)) for i in range(5000)] + [(5000 + i, "common rare rare") for i in range(20)]
    s = segment(docs, 64)
    q = blockmax._questions([(1, "common rare")])
    where = s.lists(q.key, q.key2)
    best = blockmax.Best(10)
    s.search(where, np.array([blockmax.weight(len(docs), int(s.list_docs[i])) for i in where]), best)
    assert list(best.doc) == list(range(5000, 5010)) and s.open.sum() < 5


def test_numbers_are_packed_to_their_bits():
    values = np.array([0, 5, 1023, 1, 0, 77])
    width = blockmax.bits(values)
    assert width.tolist() == [0, 3, 10, 1, 0, 7]
    width[:] = 10
    at = np.arange(6) * 10
    loose = np.zeros(64, np.uint8)
    blockmax.pack(values, at, width, loose)
    data = np.append(np.packbits(loose, bitorder="little"), np.zeros(8, np.uint8))
    assert blockmax.unpack(data, at, width.astype(np.int64)).tolist() == values.tolist()


def test_a_task_that_indexes_much_text_holds_little_of_it():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(30_000)])
    text = " ".join(words[rng.integers(0, 30_000, 200_000)])
    each = [text[i : i + 3000] for i in range(0, len(text), 3000)]
    batches = (pa.RecordBatch.from_arrays([pa.array(range(len(each))), pa.array(each)], names=["did", "text"]) for _ in range(20))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in blockmax._indexer(8000, 4_000_000, blockmax.SEGMENT_BYTES, blockmax.BLOCK)(batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 1
    assert peak < 160 << 20  # segments of 16 MB took over 300
