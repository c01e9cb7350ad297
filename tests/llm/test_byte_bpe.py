"""Byte-level BPE against tiktoken."""

import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
from rulespark.llm import bytebpe  # noqa: E402


def ranks_of(name):
    with open(P.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


RANKS = ranks_of("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGES = bytebpe.Merges(bytebpe.Ranks.of(RANKS))

TEXTS = [
    "", " ", "  ", "\n", " \n x", "a", "don't we'll I've you're she'd it's I'm", "'s", " 's", "''s", "!'s x's's 'stuff 'rest 'vet", "DON'T 'S 'LL", "a'l", "a'", "a'r", "x 'll'", "1'2's3'd4",
    "tabs\t\tand  spaces   end  ", "a b  c 　d ", "中文字符。日本語テキスト", "١٢٣ ⅷ ² x²", "éä", "😀😃 👩‍👩‍👧", "\x00\x1c\x1f\x7f", "ßªDž\U0001d400\U00010400", "a b" * 300, "x" * 5000, "ab" * 3000, " " * 3000, "\n \n" * 500,
    "Ñandú  l’été\r\n\r\n\tÜber-größe", "'s" * 500, "…—“quoted”", "͸�", "naïve's café’s",
]


def test_every_text_is_cut_as_the_library_cuts_it():
    for t in TEXTS:
        data = t.encode()
        ids, begin, first = MERGES.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ids.tolist() == LIBRARY.encode_ordinary(t), t[:40]
        assert MERGES.decode(ids, begin) == data and first.tolist() == [0, len(ids)]
        assert [int(b) for b in begin] == [len(MERGES.decode(ids[:i])) for i in range(len(ids))][: len(begin)]


def test_texts_side_by_side_do_not_meet():
    data = [t.encode() for t in TEXTS]
    ids, _, first = MERGES.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [LIBRARY.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '\n\tstmdrevlaL1²٣中é😀!. 　"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_any_texts(texts):
    data = [t.encode() for t in texts]
    ids, begin, first = MERGES.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert MERGES.decode(ids, begin) == b"".join(data)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abehlnorstu"), min_size=1, max_size=400))
def test_short_long_and_single_merges_agree(word):
    want = MERGES.single(word.encode()).tolist()
    assert MERGES.long(word.encode()).tolist() == want and MERGES.short([word.encode(), b"the"])[0].tolist() == want


def test_ranks_out_of_order_are_merged_one_by_one():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bcd": 258, b"abcabc": 259, b"cab": 260}
    own = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = bytebpe.Merges(bytebpe.Ranks.of(ranks))
    for w in ("abcab" * 40, "abcd" * 40, "cabcab" * 30 + "d"):
        want = own.encode_ordinary(w)
        assert merges.long(w.encode()).tolist() == want and merges.short([w.encode()])[0].tolist() == want


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bytebpe.Ranks.of({b"a": 0})


def test_scan_equals_a_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 4097):
        symbols = rng.integers(0, 2 * bytebpe.SYMBOLS, n).astype(np.uint8)
        state, want = bytebpe.BEGIN, []
        for s in symbols:
            want.append(state)
            state = bytebpe.AFTER[s, state]
        assert bytebpe.FUNCTIONS[bytebpe.composed_before(symbols), bytebpe.BEGIN].tolist() == want


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id's", "x"), (3, None, "x"), (3, "twice", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    long = bytebpe.parts(np.frombuffer(b"a b" * 300, np.uint8), 100)
    assert len(list(long)) > 5
    for limit in (100, 1 << 20):
        got = bytebpe.encode(docs, limit=limit)
        for r in got.collect():
            want = LIBRARY.encode_ordinary(r.row.text or "")
            assert r.ids == want and r.n_tokens == len(want) and r.row.n_tokens == "x"
            assert r.offsets == [len(b"".join(LIBRARY.decode_single_token_bytes(x) for x in want[:i])) for i in range(len(want))] if len(want) < 50 else r.offsets[0] == 0
        for r in bytebpe.round_trip(docs, limit=limit).collect():
            want = LIBRARY.encode_ordinary(r.row.text or "")
            assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((r.row.text or "").encode()).hexdigest()
    back = bytebpe.decode_table(got.select("row.text", "ids"))
    assert all(r.data == (r.row.text or "").encode() for r in back.collect())
    odd = spark.createDataFrame([([1, None],), (None,), ([70000],), ([-1],), ([],)], "ids array<int>")
    assert [r.data for r in bytebpe.decode_table(odd).collect()] == [None, None, None, None, b""]
    assert bytebpe.encode(docs.limit(0)).collect() == []


def test_bytes_that_are_not_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert bytebpe.encode(docs).first().ids == LIBRARY.encode_ordinary("a�b")


def test_query_equals_the_library(spark):
    from rulespark.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = LIBRARY.encode_ordinary(d.text)
        assert tuple(got[d.doc_id])[1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())
