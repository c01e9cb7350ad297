import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute_force as B
from rulespark.llm import components, neardup
from rulespark.llm.components import connected_components
from rulespark.llm.neardup import near_duplicates
from rulespark.llm.scratch import Scratch
from rulespark.llm.suffixdedup import LogSuffixIndex, remove_repeats

DOCS = "doc_id long, text string, source string"


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["été", "ñu"]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            base = r.choice(rows)[1].split(" ")
            for _ in range(r.randrange(0, 4)):
                base[r.randrange(len(base))] = r.choice(words)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 8, 40, 90])))))
    return rows


EDGE = [(100, None), (101, ""), (102, "   \t\n"), (103, "One"), (104, "one"), (None, "lonely words stand here"), (106, "a b"), (107, "A  B"), (108, "x " * 3000), (109, "x " * 3000), (110, "same id one two three"), (110, "same id one two three")]


@pytest.mark.parametrize("k,per_cent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, k, per_cent):
    rows = corpus(1) + EDGE
    got = near_duplicates(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS), shingle=k, per_cent=per_cent)
    want = B.near(rows, k, per_cent)
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=key) == sorted(want, key=key)


def test_long_lists_and_blocks_stay_exact(spark):
    """Tiny limits force the cluster, centre and block paths."""
    r = random.Random(5)
    base = ["t%d" % i for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(60)] = "m%d" % r.randrange(10_000)
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS), shingle=3, per_cent=85, short_list=4, block=500)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == sorted(B.near(rows, 3, 85))


def test_the_table_of_common_values_has_no_cap_that_ties_texts_together(spark):
    """More values than a list of 262,144 holds, all equally common: the order must put them last."""
    counts = spark.range(300_000).selectExpr("xxhash64(id) AS v", "IF(id % 3 = 0, 40L, 64L) AS count")
    table = neardup._common(counts)
    got = table[neardup.slot_of(np.array([r.v for r in counts.select("v").collect()], np.int64).view(np.uint64), table)]
    assert got.min() >= 5 and len(table) <= neardup.SLOTS


@pytest.mark.parametrize("slots,counted", [(2, 1), (64, 2)])
def test_any_table_gives_the_same_links(spark, monkeypatch, slots, counted):
    monkeypatch.setattr(neardup, "SLOTS", slots)
    monkeypatch.setattr(neardup, "COUNTED", counted)
    rows = corpus(7) + EDGE
    got = near_duplicates(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS), shingle=3, per_cent=85, short_list=3)
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=key) == sorted(B.near(rows, 3, 85), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_duplicates(none).collect() == []
    assert remove_repeats(none).collect() == []


@pytest.mark.parametrize("split", [0, 1_000_000])
def test_components(spark, monkeypatch, split):
    monkeypatch.setattr(components, "SPLIT", split)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("length,gram", [(20, 8), (100, 32)])
def test_repeats_equal_brute_force(spark, length, gram):
    r = random.Random(length)
    passages = ["".join(r.choice("abcdé ") for _ in range(130)) for _ in range(4)]
    rows = []
    for i in range(50):
        parts = ["".join(r.choice("abcdefghij ñ") for _ in range(r.randrange(0, 160))) for _ in range(3)]
        if r.random() < 0.7:
            p = r.choice(passages)
            a = r.randrange(0, 40)
            parts.insert(r.randrange(4), p[a : a + r.randrange(60, 131)])
        rows.append((i * 3, "".join(parts)))
    rows += [(1, "z" * 400), (2, "ab" * 300), (4, None), (5, ""), (7, rows[3][1]), (7, rows[5][1]), (None, rows[9][1]), (8, ("spaced out line of text\n" * 30))]
    got = remove_repeats(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS), length=length, gram=gram, batches=3)
    out = [(x.row.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(out, key=key) == sorted(B.repeats(rows, length), key=key)


def test_later_documents_meet_a_kept_index(spark, tmp_path):
    r = random.Random(8)
    passages = ["".join(r.choice("abcdé ") for _ in range(90)) for _ in range(3)]
    rows = [(i, "".join(r.choice("abcdefghij ñ") for _ in range(r.randrange(0, 80))) + r.choice(passages)[r.randrange(0, 30) :] + "".join(r.choice("abcdef ") for _ in range(40))) for i in range(40)]
    frame = lambda some: spark.createDataFrame([(d, t, "s") for d, t in some], DOCS)
    root, out = f"file://{tmp_path}/index", []
    for a, b in ((0, 10), (10, 20), (20, 30), (30, 40)):
        index = LogSuffixIndex(spark, root, 20, 8)
        got = remove_repeats(frame(rows[a:b]), batches=2 if a == 10 else 1, index=index, earlier=frame(rows[:a]))
        out += [(x.row.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()]
    assert sorted(out) == sorted(B.repeats(rows, 20))
    assert [size for size, _ in LogSuffixIndex(spark, root, 20, 8).levels] == [2, 0], "five batches: four merged twice, one alone"


def test_kept_text_keeps_characters_whole(spark):
    r = random.Random(1)
    p = "".join(r.choice("éñüöàç") for _ in range(60))
    rows = [(1, "a" + p), (2, "bb" + p + "tail")]
    got = {x.row.doc_id: x.kept_text for x in remove_repeats(spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS), with_text=True).collect()}
    assert got[1] == "a" + p and got[2].startswith("bb") and got[2].endswith("tail") and "�" not in got[2]
