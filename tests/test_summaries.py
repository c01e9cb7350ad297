"""Summaries of values: equal to the table where they are exact, within their bounds where they are not."""

import pytest
from pyspark.sql import functions as F

from rulespark import catalogue, pipeline
from rulespark.operators import profile, summaries
from rulespark.plans import models
from rulespark.sources.sinks import Store

SF = "/root/testdata/sf0.001"


def test_first_values_are_those_of_the_table(spark):
    rows = [("a", " x ", 1), ("a", "y", None), ("b", "x", 3), ("b", "", 3), (None, None, 4), (None, "w", 4)]
    df = spark.createDataFrame(rows, "part string, t string, n int")
    parts = summaries.summarized(df, ["t", "n", "absent", "t"], "part")
    assert {(r.part, r.col, r.n_rows, r.filled) for r in parts.collect()} == {("a", "t", 2, 2), ("a", "n", 2, 1), ("b", "t", 2, 1), ("b", "n", 2, 2), (None, "t", 2, 1), (None, "n", 2, 2), ("a", "absent", 2, 0), ("b", "absent", 2, 0), (None, "absent", 2, 0)}
    whole = {r.col: r for r in summaries.merged(parts).collect()}
    assert (whole["t"].n_rows, whole["t"].filled, whole["t"].first, whole["t"].differing) == (6, 4, ["w", "x", "y"], 3)
    assert [(x.val, x.n) for x in whole["t"].frequent] == [("x", 2), ("w", 1), ("y", 1)] and whole["absent"].first == [] and whole["absent"].differing == 0
    assert sorted(map(tuple, summaries.values(summaries.merged(parts, most=2)).collect())) == sorted(map(tuple, profile.snapshot(df, ["t", "n"], 2).collect()))
    assert summaries.merged(summaries.summarized(df.limit(0), ["t"], "part")).collect() == []
    assert [tuple(r) for r in summaries.counted(df, "t", ["x", "z"]).collect()] == [("x", 2)] and summaries.counted(df, "t", []).collect() == []


def test_errors_stay_within_their_bounds(spark):
    # 20,000 values of which the first are far more frequent, in 30 parts
    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("warm"), F.col("id") % 7)).otherwise(F.concat(F.lit("v"), F.hash("id") % 20_000)).alias("v"), (F.col("id") % 30).alias("part"))
    got = summaries.merged(summaries.summarized(df, ["v"], "part"), top=8).first()
    exact = {r.v: r.n for r in df.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert abs(got.differing - len(exact)) <= 4 * 0.01625 * len(exact) and got.filled == 120_000
    assert [x.val for x in got.frequent][0] == "hot" and {x.val for x in got.frequent} >= {f"warm{i}" for i in range(7)}
    assert all(abs(x.n - exact[x.val]) <= summaries.FREQUENT_ERROR * got.filled for x in got.frequent)


def test_quantiles_stay_within_the_rank_error(spark):
    df = spark.range(200_000).select((F.col("id") % 40).alias("part"), F.when(F.col("id") % 11 > 0, F.pow(F.hash("id") % 1000, 2).cast("long")).alias("x"))
    got = summaries.quantiles(summaries.number_merged(summaries.number_sketches(df.withColumn("g", F.lit("all")), ["part", "g"], "x"), ["g"]), ["g"], catalogue.SHARES).first()
    xs = sorted(r.x for r in df.filter("x is not null").collect())
    assert (got.n, got.total, got.least, got.most) == (len(xs), sum(xs), xs[0], xs[-1])
    for share, x in zip(catalogue.SHARES, got.quantiles, strict=True):
        assert sum(v < x for v in xs) / len(xs) - 0.014 <= share <= sum(v <= x for v in xs) / len(xs) + 0.014
    none = summaries.quantiles(summaries.number_sketches(spark.createDataFrame([("g", None)], "g string, x long"), ["g"], "x"), ["g"], [0.5]).first()
    assert none.n == 0 and none.quantiles is None


def test_quantiles_of_chunk_sizes(spark):
    sizes = {}
    for r in catalogue.chunk_word_counts(spark, SF).collect():
        sizes.setdefault(r.method, []).append(r.words)
    rows = {r.method: r for r in catalogue.chunk_size_quantiles(spark, SF).collect()}
    assert set(rows) == set(sizes) == {"per_page", "whole_document"}
    for method, xs in sizes.items():
        for share, x in zip(catalogue.SHARES, rows[method].quantiles, strict=True):
            assert sum(v < x for v in xs) / len(xs) - 0.014 <= share <= sum(v <= x for v in xs) / len(xs) + 0.014


def _store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    kind = "policy_id string, topic string, department string, status string"
    store.append("policies", spark.createDataFrame([("p1", "Travel", None, "active"), ("p2", "Meals", "HR", "active")], kind))
    return store, kind


def test_context_reads_no_old_batch(spark, tmp_path):
    store, kind = _store(spark, tmp_path)
    assert pipeline.summarize(store) > 0 and pipeline.summarize(store) == 0
    old = store.folders("policies")
    store.append("policies", spark.createDataFrame([("p3", "Leave", "Legal", None), ("p4", " Travel ", "HR", "retired")], kind))
    want = models.context(store.read("policies"))
    store._delete(old)  # the past goes away; whoever reads it fails
    assert pipeline.snapshot_context(store)() == want and "topic: Leave" in want and want.startswith("rows: 4")
    assert pipeline.summarize(store) > 0
    top = {r.col: [(x.val, x.n) for x in r.frequent] for r in pipeline.value_summary(store).collect()}
    assert top["topic"] == [("Travel", 2), ("Leave", 1), ("Meals", 1)] and top["department"] == [("HR", 2), ("Legal", 1)]


def test_summaries_follow_rewrites(spark, tmp_path):
    store, kind = _store(spark, tmp_path)
    for i in range(3):
        pipeline.summarize(store)
        store.rewrite("policies", spark.createDataFrame([("p1", f"T{i}", None, "active")], kind))
        assert pipeline.snapshot_context(store)() == f"rows: 1\nstatus: active\ntopic: T{i}"
    pipeline.summarize(store)
    assert store.read("_value_summaries").select("part").distinct().count() <= 2
    store.rewrite("policies", spark.createDataFrame([], kind))
    assert pipeline.snapshot_context(store)() == "rows: 0"


def test_no_rules_no_summary(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert pipeline.value_summary(store) is None and pipeline.summarize(store) == 0 and pipeline.snapshot_context(store)() == ""


@pytest.mark.parametrize("columns", [["t"], ["t", "u"]])
def test_many_parts_with_one_hot_part(spark, columns):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("part"), (F.col("id") % 250).cast("string").alias("t"), F.lit(None).cast("string").alias("u"))
    got = {r.col: r for r in summaries.merged(summaries.summarized(df, columns, "part"), most=5).collect()}
    assert got["t"].first == sorted(str(i) for i in range(250))[:5] and got["t"].n_rows == 3000
