"""Names that are spelled alike, against all pairs."""

import random

import pytest

from rulespark.operators import ingest, names
from rulespark.plans import models


def parts(name):
    p = "  " + " ".join(name.lower().split()) + "  "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def plain(rows, threshold):
    counts = {}
    for r in rows:
        if r is not None and r.strip(" "):
            counts[r] = counts.get(r, 0) + 1
    pairs = {(a, b) for a in counts for b in counts if a < b and len(parts(a) & parts(b)) >= threshold * len(parts(a) | parts(b)) - 1e-9}
    group = {n: {n} for n in counts}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    best = {n: min(g, key=lambda x: (-counts[x], x)) for n, g in group.items()}
    return pairs, {n: c for n, c in best.items() if n != c}


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = ["travel", "Travel", "travels", "holiday", "holidays", "expense", "expenses", "ab", "a", "aaaa", "aaaaaa"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(150)] + ["Travel  policy", "travel policy", "Travel policy", None, "", " ", "x", "日本語", "日本語 "]
    df = spark.createDataFrame([(r,) for r in rows], "topic string")
    pairs, renamed = plain(rows, threshold)
    found = names.alike(df.selectExpr("topic as name").filter("trim(name) <> ''").distinct(), threshold)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(pairs)
    assert {r.original: r.canonical for r in names.mapping(df, "topic", threshold).collect()} == renamed


def test_long_chains_settle(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(200)]
    random.Random(1).shuffle(chain)
    got = names.groups(spark.createDataFrame(chain, "a string, b string"))
    assert {(r.name, r.group) for r in got.collect()} == {(f"{i:03d}", "000") for i in range(201)}


def test_topics_merge_without_a_model(spark):
    df = spark.createDataFrame([("Travel policy",)] * 3 + [("travel  policy",), ("Travel policies",), ("Leave",)], "topic string")
    out, changed = ingest.renamed(df, "topic", models.topic_mapping(spark, df))
    assert sorted(r.topic for r in out.collect()) == ["Leave", "Travel policies"] + ["Travel policy"] * 4 and changed.count() == 1
    assert names.mapping(df.limit(0), "topic").count() == 0
    with pytest.raises(ValueError):
        models.topic_mapping(spark, df, lambda known: {}, most=2)
