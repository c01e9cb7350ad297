import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulespark.functions import chunks, lines

from rulespark.functions import text as X


def value(spark, make, said):
    return spark.createDataFrame([(said,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_sections(spark):
    got = value(spark, X.sections, "lost\n# One\nbody a\n\n## Two\n\nbody b\n### Empty\n")
    assert [(s.heading, s.body) for s in got] == [("One", "body a"), ("Two", "body b")]
    kept = value(spark, lambda c: X.sections(c, True), "lost\n# One\nbody")
    assert [(s.heading, s.body) for s in kept] == [("Preamble", "lost"), ("One", "body")]
    assert [(s.heading, s.body) for s in value(spark, X.sections, "p one\n\n\np two\nmore")] == [("Section 1", "p one"), ("Section 2", "p two\nmore")]
    assert value(spark, X.sections, None) == [] and value(spark, X.sections, " \n ") == []


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 20))
def test_chunks_keep_words_and_size(spark, text, size):
    chunks = value(spark, lambda c: X.char_chunks(c, size), text)
    assert " ".join(chunks).split() == text.split()
    assert all(len(c) + 1 <= size or " " not in c for c in chunks)
    windows = value(spark, lambda c: X.word_chunks(c, 3, 1), text)
    n = len(text.split())
    assert len(windows) == -(-n // 2)


def test_cleaning(spark):
    assert value(spark, X.quiet_lines, "Page 3 | 9\n\n12/3 - 4\nshort line\nthis line has  five words") == "this line has five words"
    assert value(spark, X.joined_glyphs, "in A u g u s t 2 0 2 5") == "in August 2025"
    assert value(spark, X.transcript, "Ann Lee   14:28\nokay\nSo, we start\nnow") == "we start now"
    assert value(spark, X.summary, "Short. " + "long " * 60).endswith("...")
    assert value(spark, X.summary, "This first sentence is long enough. Rest.") == "This first sentence is long enough."


@pytest.mark.parametrize("text,kind", [(None, "filler"), ("thanks, bye", "filler"), ("Lisa 14:28", "transcript_metadata"), ("If late, you must call", "policy_rule"), ("Open the app", "procedure"), ("We recommend tea", "recommendation"), ("It means work", "definition"), ("How far is it?", "faq"), ("The owner is Kim", "action_item"), ("A calm day", "discussion")])
def test_chunk_types(spark, text, kind):
    assert value(spark, X.chunk_type, text) == kind


def test_rules(spark):
    assert value(spark, X.condition, "When it rains, staff must stay. Bye") == "Whenit rains"
    assert value(spark, X.action, "When it rains, staff must stay. Bye") == "Muststay. Bye"
    assert value(spark, lambda c: X.action(c, True), "Staff must stay. Bye") == "Muststay"
    assert value(spark, X.annual_amount, "up to $5,000 per year") == 5000.0
    assert value(spark, X.annual_amount, "1200 annual") == 1200.0 and value(spark, X.annual_amount, "none") is None
    assert value(spark, X.entities, "Then Mary Jones Smith met So Called with OneLogin, Mary Jones Smith") == ["Mary Jones Smith", "OneLogin"]
    assert value(spark, X.required_tokens, "visa_required and badge_required, visa_required") == ["badge_required", "visa_required"]


def test_lists(spark):
    nine = "Company holidays:\n" + "\n".join(f"- Day {i}" for i in range(9))
    t = X.list_text(F.col("t"))
    row = spark.createDataFrame([(nine,), ("holiday a e holiday b e labor day",), ("Tools: hammer",)], "t string").select(X.list_items(t).alias("i"), X.list_heading(t).alias("h"), X.list_topic(X.list_heading(t)).alias("p")).collect()
    assert len(row[0].i) == 9 and row[0].h == "Company holidays" and row[0].p == "Holidays"
    assert row[1].i == ["holiday b", "labor day"]
    assert row[2].i == ["hammer"] and row[2].p == "Tools"


def test_merge(spark):
    got = spark.createDataFrame([("a\nb", "b\n\nc"), ("", "x"), ("x", None), ("a", "a")], "p string, o string").select(X.merged_lines(F.col("p"), F.col("o")).alias("m")).collect()
    assert [r.m for r in got] == ["a\nb\n\n[OCR Merge]\n\nc", "x", "x", "a"]


def test_small_helpers(spark):
    assert value(spark, lambda c: X.ellipsis(c, 10), "abcdefghijklm") == "abcdefg..."
    assert value(spark, lambda c: X.file_name(c, F.lit("t")), "file:///a/b%20c.txt") == "b c.txt"
    assert value(spark, lambda c: X.file_name(c, F.lit("")), "http://x") == "document"
    assert value(spark, X.skips_verification, "short") is True
    assert value(spark, lambda c: X.unsupported_numbers(c, F.lit("section 1507.2")), "see 1507.2 and 88") == ["88"]


def plain_cover(source, merged):
    strip = lambda x: " ".join(re.split(r"[ \t\n\x0b\f\r]+", x)).strip(" ")
    rows = [strip(x) for x in source.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    rows = [x for x in rows if sum(c.isascii() and c.isalnum() for c in x) >= 2]
    return len(rows), [x for x in rows if x not in strip(merged)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t\ré\u00a0"), max_size=60), st.text(st.sampled_from("ab1 \n\t\ré\u00a0"), max_size=60))
def test_line_cover_equals_a_search_for_every_line(source, merged):
    assert lines.cover(source, merged) == plain_cover(source, merged)


def test_lines_take_time_in_proportion_to_the_texts():
    def took(n):
        source = "\n".join(f"line {i * 7919 % 1000003} of the page" for i in range(n))
        merged = " ".join(f"line {i * 7919 % 1000003} of the page and" for i in range(0, n, 2))
        began = time.perf_counter()
        count, lost = lines.cover(source, merged)
        assert count == n and len(lost) == n // 2
        assert len(lines.merge(source, merged + "\n" + source)) == len(source) + len("\n\n[OCR Merge]\n") + len(merged)
        return time.perf_counter() - began

    took(1000)
    assert took(320_000) < 8 * 3 * took(40_000), "from 1 to 8 MB"


def test_line_columns(spark):
    rows = [("a1 b\nc2 d\n!\nc2  d", "x a1 b y", None), (None, "q", "zz"), ("a1", None, ""), ("", "", "")]
    got = spark.createDataFrame(rows, "s string, m string, o string").select(X.line_cover(F.col("s"), F.col("m")).alias("c"), X.covered_lines(F.col("s"), F.col("m")).alias("n"), X.page_statistics(F.col("s"), F.col("o"), F.col("m")).alias("p")).collect()
    assert [(r.c.solid, r.c.lost, r.n) for r in got] == [(3, ["c2 d", "c2 d"], 1), (0, [], 0), (1, ["a1"], 0), (0, [], 0)]
    assert got[0].p.text_lines_missing == 2 and got[1].p.ocr_lines == 1 and got[1].p.ocr_lines_covered == 0


def test_chunks_take_time_in_proportion_to_the_text():
    def took(n):
        text = "word " * n
        began = time.perf_counter()
        assert sum(len(c.split()) for c in chunks.by_chars(text, 400)) == n
        made = chunks.by_paragraphs("one two three\n\n" * (n // 3), 120, 180)
        assert 0 <= -(-(n // 3) // 60) - len(made) <= 1
        return time.perf_counter() - began

    took(1000)
    assert took(1_200_000) < 10 * 3 * took(120_000), "from 0.6 to 6 MB"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(1, 40))
def test_cuts_equal_a_loop(sizes, size):
    want, used = [], 0
    for i, n in enumerate(sizes):
        if not want or used + n > size:
            want.append(i)
            used = 0
        used += n
    assert chunks.cuts(np.array(sizes, np.int64), size) == [*want, len(sizes)][0 if sizes else 0 :] or not sizes and chunks.cuts(np.array(sizes, np.int64), size) == [0]


def test_chunk_columns(spark):
    rows = [("a bb  ccc\td",), ("",), (None,), ("longwordhere x",)]
    got = spark.createDataFrame(rows, "t string").select(X.char_chunks(F.col("t"), 5).alias("c"), X.paragraph_chunks(F.col("t")).alias("p")).collect()
    assert [r.c for r in got] == [["a bb", "ccc", "d"], [], [], ["longwordhere", "x"]] and [r.p for r in got] == [["a bb  ccc\td"], [], [], ["longwordhere x"]]


def test_page_cover_sends_back_counts_only():
    import pyarrow as pa

    from rulespark.functions import lines

    texts, merged = ["one line\ntwo lines\n--", "gone away\ngone away"], ["two lines", "kept"]
    (got,) = lines.page_cover.func(iter([(pa.array(texts), pa.array(["two lines", ""]), pa.array(merged))]))
    assert [tuple(r.values()) for r in got.to_pylist()] == [(2, 1, 1, 0), (2, 2, 0, 0)]
