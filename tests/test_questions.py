"""Tables of questions against one question at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rulespark.operators import keywords
from rulespark.plans import questions, search, spec

WORDS = ["leave", "Travel", "billing code", "50% rate", "a_b", "holiday", "Ärzte", "client dinner", "日本", ""]


def rules(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([None, "", *x])
    rows = []
    for i in range(90):
        rows.append((i // 2 if i % 7 == 0 else i, pick("d1", "d2", "d3"), pick("b1", "bat_2"), pick("s1", "s2", "s3", "s4", "s5"), pick("billing", "travel", "payroll"), pick(*WORDS), pick("x", "sub Leave"), pick("internal marketing", "none"), rng.choice(["active", "active", "old", None]), pick("If so"), pick("Do it", "ask for leave_x"), pick("sum mary"), pick(*WORDS)))
    rows += rows[:3]
    return spark.createDataFrame(rows, "policy_id long, document_id string, batch_id string, section_id string, policy_category string, topic string, subtopic string, activity_type string, status string, condition_text string, action_text string, summary string, source_quote string")


def specs(seed):
    rng = random.Random(seed)
    out = [spec.SearchSpec({}, ("policy_id",)), spec.SearchSpec({"status": "none"}, ("policy_id",)), spec.SearchSpec({"status": "gone", "document_id": "d1"}, ("policy_id",)), spec.SearchSpec({"batch_id": "nowhere"}, ("policy_id",))]
    for _ in range(14):
        f = {}
        for k, values in (("status", ["active", "old", ["active", "old"]]), ("topic", [*WORDS, ["LEAVE", "travel"], "nothing"]), ("subtopic", ["SUB leave", "y"]), ("policy_category", ["billing", ["travel", "payroll"], "odd"]), ("activity_type", ["none", "internal marketing", "zzz"]), ("document_id", ["d1", ["d2", "d3"], "d9"]), ("batch_id", ["b1", ""])):
            if rng.random() < 0.45:
                f[k] = rng.choice(values)
        out.append(spec.SearchSpec(f, ("policy_id",), intent=rng.choice(["fallback", "complete_list", "definition"])))
    return out


def rows_of(asked, texts):
    many = lambda v: list(v) if isinstance(v, (list, tuple)) else [v]
    return [(i, t, s.intent, {k: many(v) for k, v in s.filters.items()}) for i, (s, t) in enumerate(zip(asked, texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_table_of_questions_equals_one_at_a_time(spark, seed):
    resolved = rules(spark, seed)
    # without a status "active", the last step of a question that names none finds nothing, and keywords are tried
    tables = [resolved] if seed == 1 else [resolved.filter("status is null or status <> 'active'")]
    asked = specs(seed)
    texts = [random.Random(seed + i).choice(["what about leave and a_b?", "Travel", "no such thing", "", "the what"]) for i in range(len(asked))]
    for table in tables:
        table = table.coalesce(1).cache()
        got = {}
        q = spark.createDataFrame(rows_of(asked, texts), f"id long, question string, intent string, filters {questions.FILTERS}")
        for r in questions.answers(table, q).orderBy("id", "rank").collect():
            got.setdefault(r.id, (r.step, []))[1].append(r.policy_id)
            assert got[r.id][0] == r.step and len(got[r.id][1]) == r["rank"]
        for i, s in enumerate(asked):
            found, step = search.run(table, s, texts[i])
            want = [r.policy_id for r in found.collect()]
            have = got.get(i, (None, []))
            assert have[1] == want, (i, s, texts[i])
            assert not want or (have[0] == -1) == (step == -1)


def test_questions_are_planned_by_rules(spark):
    texts = ["What are all the holidays in bat_7?", "Can I travel, document_id: d-1", "internal marketing codes", None, ""]
    q = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    got = {r.id: r for r in questions.planned(q).collect()}
    for i, t in enumerate(texts):
        kind = spec.question_class(t)
        want = spec.with_intent(spec.SearchSpec({k: v for k, v in {"status": "active", **kind, **spec.scope_of(t)}.items() if v}), spec.intent_of(t))
        assert got[i].intent == want.intent and {k: v[0] for k, v in got[i].filters.items()} == want.filters


def test_the_plan_reads_rules_once_for_all_questions(spark):
    q = spark.createDataFrame([(i, f"q{i}", "fallback", {"status": ["active"], "topic": [f"t{i}"]}) for i in range(200)], f"id long, question string, intent string, filters {questions.FILTERS}")
    assert questions.answers(rules(spark, 3), q).groupBy("id").count().count() == 200


def docs(spark):
    rows = [(1, "Invoice overdue; where is it"), (1, "Invoice overdue; where is it"), (1, "other"), (None, "an invoice"), (2, "where_is data"), (3, None), (4, ""), (5, "ABOUT 50% of größe"), (6, "日本語 text")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("wildcards", [False, True])
def test_terms_are_found_where_the_scan_finds_them(spark, wildcards):
    table, rows = docs(spark)
    terms = ["invoice", "voice", "in", "e", "where_is", "where is", "50%", "%", "größe", "röß", "本", "; w", "", "zebra", "data", "_"]
    texts = keywords.marked(table, ["doc_id"], ["text"])
    got = keywords.holders(spark.createDataFrame([(t,) for t in [*terms, None]], "term string"), keywords.postings(texts, ["doc_id"]), texts, ["doc_id"], wildcards)
    low = table.withColumn("text", F.coalesce(F.lower("text"), F.lit("")))
    for t in terms:
        test = F.col("text").like(f"%{t}%") if wildcards else F.col("text").contains(t)
        want = sorted({(r.doc_id or 0, r.text) for r in low.filter(test).collect()})
        assert len([r for r in got.filter(F.col("term") == t).collect()]) == len(want), t
    assert got.filter("term is null").count() == 0


def test_an_index_of_batches_equals_the_scan(spark, tmp_path):
    table, rows = docs(spark)
    q = spark.createDataFrame([(0, "what about the invoice and where_is data"), (1, "größe"), (2, "the"), (3, None), (4, "invoice overdue invoice text")], "q long, t string")
    index = keywords.KeywordIndex(spark, f"file://{tmp_path}/i", "doc_id", buckets=16)
    index.add("b1", table.filter("doc_id = 1"), ["text"])
    index.add("b2", table.filter("doc_id is null or doc_id > 2"), ["text"])
    index.add("b2", table.filter("doc_id is null or doc_id > 1"), ["text"])
    for use in (None, index):
        found = keywords.fallback(table, q, "doc_id", ["text"], "q", "t", limit=3, index=use)
        best = keywords.overlap(table, q, "doc_id", ["text"], "q", "t", limit=3, index=use)
        for r in q.collect():
            mine = [x.doc_id for x in found.filter(F.col("id") == r.q).orderBy("rank").collect()]
            one = search.keyword_fallback(table.withColumn("policy_id", F.col("doc_id")), spec.SearchSpec({}, ("doc_id",)), r.t, limit=3, columns=("text",))
            assert mine == ([x.doc_id for x in one.collect()] if one is not None else [])
            scores = [x.score for x in best.filter(F.col("id") == r.q).orderBy("rank").collect()]
            plain = search.overlap_topk(table.dropDuplicates(), r.t or "", ("text",), ["doc_id"], 3).filter("score > 0")
            assert scores == [x.score for x in plain.collect()]


def test_a_search_reads_the_listed_postings_only(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" common")).alias("text"))
    index = keywords.KeywordIndex(spark, f"file://{tmp_path}/i", "doc_id", buckets=32)
    index.add("b", rows, ["text"])
    pairs = keywords.tokens_of(spark.createDataFrame([("word399",), ("word77x",)], "fragment string"), spark.read.parquet(f"{index.path}/vocabulary"))
    listed = index.listed(pairs)
    assert len(listed.inputFiles()) <= 8 < len(spark.read.parquet(f"{index.path}/postings").inputFiles()) and listed.filter("token = 'word399'").count() == 1


def test_contains_join_keeps_rows_ids_and_nulls(spark):
    rows = [(1, "Has the item here"), (1, "Has the item here"), (None, "Has the item here"), (2, None), (3, ""), (4, "xthe itemy; ΟΔΟΣΑ"), (5, "the  item"), (6, "..!")]
    items = [(9, "the item"), (9, "the item"), (None, "as the item h"), (8, ""), (7, None), (6, "ΟΔΟΣ"), (5, "!"), (4, "The item"), (3, "a")]
    got = keywords.contains_join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    want = [(d, i) for d, t in rows for i, n in items if t is not None and n is not None and n in t]
    order = lambda r: [(v is not None, v or 0) for v in r]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_keys_of_documents_and_sections_stay_apart(spark):
    rows = [("p1", "d1", "s1", "Holidays", "active"), ("p2", "d1", None, None, "active"), ("p3", None, "s1", "x", "active"), ("p4", "s1", "d1", "x", "active"), ("p5", None, None, "x", "active"), ("p6", "d1", "s9", "Holidays", "old")]
    none = [F.lit(None).cast("string").alias(c) for c in ("subtopic", "condition_text", "action_text", "summary", "source_quote", "policy_category")]
    df = spark.createDataFrame(rows, "policy_id string, document_id string, section_id string, topic string, status string").select("*", *none)
    got = search.complete_list(df, spec.SearchSpec({"status": "active", "topic": "holidays"}, ("policy_id",), intent="complete_list"))
    # a section's key is no document's, even if they are spelled alike
    assert sorted(r.policy_id for r in got.collect()) == ["p1", "p2", "p3"]


def test_only_the_first_rows_of_a_term_meet_the_questions(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id AS doc_id", "'travel and leave' AS text")
    asked = spark.createDataFrame([(i, "travel leave policy") for i in range(3)], "question_id long, question string")
    met, plain = [], keywords.best_of
    monkeypatch.setattr(keywords, "best_of", lambda found, *a: met.append(found.count()) or plain(found, *a))
    got = keywords.fallback(rows, asked, "doc_id", ["text"], "question_id", "question", limit=5)
    assert sorted((r.id, r["rank"], r.doc_id) for r in got.collect()) == [(i, n + 1, n) for i in range(3) for n in range(5)]
    assert met[-1] <= 3 * 5


def test_terms_are_sent_to_the_texts(spark):
    """Neither join deals the postings of all tokens out."""
    rows = spark.createDataFrame([(i, f"some travel text {i}") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "travel text"), (2, "e travel t")], "item_id long, text string")
    joined = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [token#" in joined(keywords.contains_join(rows, "doc_id", "text", items, "item_id", "text"))
    assert "BroadcastHashJoin [term#" in joined(keywords.overlap(rows, items, "doc_id", ["text"], "item_id", "text"))


def _mixed(n: int = 60) -> list[tuple]:
    """Rows of few words, some of them twice, without a key, or with one key and two texts."""
    some = ["travel", "traveller", "leave", "sleeves", "where_is", "where is", "whereXis", "über", "ab", "claims", "x1234y", "____"]
    rows = [(i if i % 9 else None, " ".join(some[(i * j + j) % len(some)] for j in range(1, 2 + i % 5))) for i in range(n)]
    return [*rows, *rows[::7], (3, "another travel text"), (4, None), (5, "")]


def _like(term: str, text: str) -> bool:
    return re.search(re.escape(term).replace("_", "."), text, re.DOTALL) is not None


def test_first_rows_of_words_over_parts_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(keywords, "POSTS", 7)
    rows = _mixed()
    asked = ["travel leave", "where_is", "____", "1234 sleeve", "zebra", "eave rave trav clai", ""]
    got = keywords.fallback(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "q long, t string"), "doc_id", ["text"], "q", "t", limit=6)
    found = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append((r["rank"], r.doc_id))
    for q, t in enumerate(asked):
        held = sorted((-1 if d is None else d) for d, x in rows if any(_like(w, (x or "").lower()) for w in t.split()))
        assert [(r, -1 if d is None else d) for r, d in found.get(q, [])] == list(enumerate(held[:6], 1)), t


def test_only_the_first_rows_of_a_token_are_dealt_out(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id AS doc_id", "'travel and leave' AS text")
    met, plain = [], keywords.best_of
    monkeypatch.setattr(keywords, "best_of", lambda found, *a: met.append(found.count()) or plain(found, *a))
    keywords.fallback(rows, spark.createDataFrame([(1, "travel leave policy")], "q long, t string"), "doc_id", ["text"], "q", "t", limit=5)
    # two tokens in each of the tasks
    assert met[0] <= rows.rdd.getNumPartitions() * 2 * 5


@pytest.mark.parametrize("key", ["long", "string", "double"])
def test_overlap_over_parts_of_the_texts(spark, monkeypatch, key):
    monkeypatch.setattr(keywords, "POSTS", 7)
    monkeypatch.setattr(keywords, "CELLS", 16)
    rows, words = _mixed(), ["travel", "leave", "where_is", "1234", "sleeve", "clai", "travel", "____"]
    asked = [(i, " ".join(words[(i + 3 * j) % len(words)] for j in range(1 + i % 4))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(key))
    found = {}
    for r in keywords.overlap(table, spark.createDataFrame(asked, "q long, t string"), "doc_id", ["text"], "q", "t", limit=4).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append((r["rank"], r.doc_id, r.score))
    order = lambda d: (d is not None, str(d) if key == "string" else d or 0)
    for q, t in asked:
        scored = [(d, sum(w in (x or "") for w in t.split())) for d, x in set(rows)]
        best = sorted(((d, n) for d, n in scored if n), key=lambda r: (-r[1], order(r[0])))[:4]
        assert [(r, None if d is None else int(d), n) for r, d, n in found.get(q, [])] == [(i, d, n) for i, (d, n) in enumerate(best, 1)], t


def test_only_the_best_rows_of_a_part_are_dealt_out(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id AS doc_id", "'travel and leave' AS text")
    items = spark.createDataFrame([(1, "travel text"), (2, "leave it")], "item_id long, text string")
    met, plain = [], keywords.best_of
    monkeypatch.setattr(keywords, "best_of", lambda found, *a: met.append(found.count()) or plain(found, *a))
    got = keywords.overlap(rows, items, "doc_id", ["text"], "item_id", "text", limit=5)
    assert met[0] <= rows.rdd.getNumPartitions() * 2 * 5
    assert sorted((r.id, r["rank"], r.doc_id) for r in got.collect()) == [(i, n + 1, n) for i in (1, 2) for n in range(5)]
