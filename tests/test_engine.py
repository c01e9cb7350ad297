import io
import json
import math
import random
import zipfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rulespark import catalogue, pipeline, schema
from rulespark.__main__ import main as command_line
from rulespark.functions import text
from rulespark.operators import admin, evolve, ingest, profile, publish, vector
from rulespark.plans import models, search, spec
from rulespark.sources import files, pages, sinks
from rulespark.sources.sinks import Store, eval_report
from rulespark.streaming import mirror

RULES = "# Travel policy\nIf a trip costs more than 1,200 per year, staff must ask for approval; keep receipts.\n\n# Days off\nCompany holidays:\n- New Year\n- May Day\n- Harvest Day\n- Founders Day\n\n# Chat\nthanks, bye\n"


def inputs(spark, text=RULES, uri="file:///p.txt"):
    return spark.createDataFrame([(uri, text, "Policy", "txt", 1), (uri, text, "Policy again", "txt", 2)], "source_uri string, raw_content string, title string, doc_type string, seq int")


def test_ingest_publish_ask(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    staged = {r.candidate.chunk_type: r for r in pipeline.ingest_batch(store, "bat_1", inputs(spark)).collect()}
    assert set(staged) == {"policy_rule", "policy_list", "filler"}
    rule, listing = staged["policy_rule"], staged["policy_list"]
    assert rule.mapped_fields["approval_required"].value == "true" and rule.mapped_fields["amount_threshold"].value == "1200.0" and rule.confidence >= 0.55
    assert listing.candidate.topic == "Holidays" and listing.confidence == 0.9 and "Founders Day" in listing.candidate.action_text
    assert not staged["filler"].candidate.publishable
    counters = pipeline.publish_batch(store).first()
    assert (counters.total, counters.published, counters.skipped) == (3, 2, 1)
    again = pipeline.publish_batch(store).first()
    assert again.published == 2 and store.read("policies").count() == 2 and store.read("audit").count() == 2
    pipeline.ingest_batch(store, "bat_1", inputs(spark))
    assert store.read("documents").count() == 1 and store.read("sections").count() == 3
    got = pipeline.ask(store, "What are all the holidays?", {"table": "policies_v2", "filters": {"topic": "Holidays"}})
    assert got["intent"] == "complete_list" and got["rows_found"] == 2 and "May Day" in got["answer"]
    wide = pipeline.ask(store, "May I?", {"table": "policies_v2", "filters": {"topic": "nothing"}})
    assert wide["relaxations"] == 1 and wide["rows_found"] == 2
    assert store.columns("policies")["topic"] == "string"
    assert set(store.tables()) == {"audit", "documents", "ingestion_batches", "policies", "schema_change_requests", "schema_migration_log", "sections", "staging"}
    batch = store.read("ingestion_batches").first()
    assert (batch.status, batch.documents_total, batch.sections_total, batch.extractions_total) == ("completed", 1, 3, 3) and '"published":2' in batch.result_summary
    assert batch.started_at is not None and batch.finished_at >= batch.started_at
    assert all(r.created_at is not None and r.updated_at is not None for r in store.read("staging").collect())


def test_null_and_blank_resolution(spark):
    p = spark.createDataFrame([(1, "s1", "", "do it", "active"), (2, None, None, "", "active"), (3, "s1", "Own", None, "old")], "policy_id long, section_id string, topic string, action_text string, status string")
    p = p.withColumns({c: F.lit(None).cast("string") for c in ("subtopic", "condition_text", "source_quote", "policy_category")})
    a = spark.createDataFrame([("1", "e1", "published"), ("1", "e1", "published"), ("3", "e2", "failed")], "policy_id string, extraction_id string, publish_status string")
    s = spark.createDataFrame([("e1", "d1", "b1", ("From staging", None))], "extraction_id string, document_id string, batch_id string, c struct<topic:string,summary:string>")
    s = s.select("extraction_id", "document_id", "batch_id", F.struct("c.topic", "c.summary", *[F.lit(None).cast("string").alias(x) for x in ("subtopic", "condition_text", "action_text", "source_quote")]).alias("candidate"))
    sec = spark.createDataFrame([("s1", "d9")], "section_id string, document_id string")
    d = spark.createDataFrame([("d9", "b9")], "document_id string, batch_id string")
    rows = sorted((r.policy_id, r.topic, r.document_id, r.batch_id) for r in search.resolved_policies(p, a, s, sec, d).collect() if r.policy_id != 2)
    assert rows == [(1, "From staging", "d1", "b1"), (1, "From staging", "d1", "b1"), (3, "Own", "d9", "b9")]
    out = search.resolved_policies(p, a, s, sec, d)
    got = search.complete_list(out, spec.SearchSpec({"status": "active", "topic": "own"}, ("policy_id",), intent="complete_list"))
    assert [r.policy_id for r in got.collect()] == [1, 1], "a section sibling in scope, not the match itself"


def test_filters(spark):
    df = spark.createDataFrame([(1, "Leave", None), (2, "LEAVE", "x"), (3, None, "y")], "id int, topic string, policy_category string")
    ids = lambda f: [r.id for r in df.filter(search.conjunction(f)).orderBy("id").collect()]
    assert ids({"topic": "leave"}) == [1, 2] and ids({"topic": ["leave", "z"], "policy_category": "x"}) == [1, 2]
    assert ids({"policy_category": ["y"]}) == [1, 3] and ids({"topic": "", "policy_category": None}) == [1, 2, 3]


def test_gaps_and_gate(spark):
    item = lambda raw, n, seen: (raw, None, seen, "new_scalar", n)
    staged = spark.createDataFrame([("e1", [item("annual_cap", 3, ["1", "2", "3"])]), ("e2", [item("Annual_Cap ", None, ["4"]), item("approver", 1, []), item("odd", 2, None), item(" ", 1, [])]), ("e3", [item("annual_cap", 1, ["5", "6"])])], f"extraction_id string, unmapped_concepts {schema.UNMAPPED}")
    got = {r.concept: r for r in evolve.gaps(staged, schema.dictionary(spark), ["topic"]).collect()}
    assert got["amount_threshold"].frequency == 5 and got["amount_threshold"].examples == ["1", "2", "4"] + [] or got["amount_threshold"].examples[:3] == ["1", "2", "4"]
    assert got["approver"].gap_type == "new_relationship" and got["odd"].gap_type == "text_only" and len(got) == 3
    made = evolve.proposals(evolve.gaps(staged, schema.dictionary(spark), ["topic"]), "b").collect()
    assert [(p.migration_class, len(p.items)) for p in made] == [("approval_required", 3)]
    assert evolve.may_apply("disallowed", "approved") and evolve.may_apply("odd", "approved") and evolve.may_apply("approval_required", "pending")
    assert evolve.may_apply("approval_required", "approved") is None and evolve.may_apply("safe_auto", "pending") is None
    table = spark.range(1)
    with pytest.raises(ValueError):
        evolve.added(table, ["x; drop"])
    ask = lambda n, decision, *items: {"request_id": n, "migration_class": "approval_required", "decision_status": decision, "items": [{"concept": c, "gap_type": t} for c, t in items]}
    out, children, log = evolve.apply(table, [ask("1", "pending", ("a", "new_scalar")), ask("2", "approved", ("b", "new_scalar"), ("approver", "new_relationship")), ask("3", "approved", ("c", "new_scalar"), ("bad name", "new_relationship"))])
    assert out.columns == ["id", "b"] and children == ["policy_approver"]
    assert [x["status"] for x in log] == ["skipped", "applied", "failed"] and "bad name" in log[2]["error_text"]


def test_contracts_overrides_and_a_model_in_ingestion(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    pipeline.bootstrap(store)
    store.insert_many("schema_dictionary_overrides", [("annual_budget", ["Annual_Cap"], ["secret_required"], {"odd_required": "approval_required"}, True), ("never", ["region_code"], None, None, False)], schema.OVERRIDES)
    text = RULES + "\n# Caps\nThe annual cap and odd_required and secret_required and plain_required fields must be set when asked.\n"

    def extractor(section):
        if "annual cap" in section:
            raise ValueError("no reply")
        return json.dumps({"chunk_type": "policy_rule", "publishable": True, "summary": "From the model", "topic": "Trips", "recommendation_text": "Ask", "confidence": 0.8 if "trip" in section else 7})

    rows = {r.section_id: r for r in pipeline.ingest_batch(store, "bat_1", inputs(spark, text), extractor).collect()}
    kinds = {r.section_id: r.heading for r in store.read("sections").collect()}
    by = {kinds[i]: r for i, r in rows.items()}
    trip = by["Travel policy"]
    assert trip.candidate.summary == "From the model" and trip.mapped_fields["action_text"].provenance == "llm:recommendation" and trip.mapped_fields["topic"].value == "Trips" and trip.confidence == 0.8
    assert trip.candidate.source_quote and trip.unmapped_concepts == [] and by["Days off"].candidate.chunk_type == "policy_list" and by["Days off"].candidate.extractor_version == "rules-1"
    assert by["Chat"].candidate.extractor_version == "rules-1", "a confidence of 7 breaks the contract"
    labels = {u.raw_label: u.normalized_label for u in by["Caps"].unmapped_concepts}
    assert "secret_required" not in labels and labels["odd_required"] == "approval_required" and labels["plain_required"] == "plain_required"
    made = pipeline.plan_changes(spark, store, "bat_1").collect()
    concepts = {i["concept"] for r in made for i in r["items"]}
    assert "plain_required" in concepts and "approval_required" in concepts
    # a payload that breaks its contract is never published
    good = store.read("staging").filter(F.col("section_id") == trip.section_id)
    bad = good.withColumn("extraction_id", F.lit("ext_bad")).withColumn("mapped_fields", F.map_from_arrays(F.array(F.lit(" ")), F.slice(F.map_values("mapped_fields"), 1, 1)))
    assert publish.published(good.unionByName(bad), ["topic"]).count() == 1
    assert {r.publish_error for r in publish.decided(bad).collect()} == {"invalid payload contract: a mapped field has no name"}


def test_no_gaps_no_proposals(spark):
    staged = spark.createDataFrame([], f"extraction_id string, unmapped_concepts {schema.UNMAPPED}")
    assert evolve.proposals(evolve.gaps(staged, schema.dictionary(spark), []), "b").collect() == []


def test_dictionary_overrides(spark):
    o = spark.createDataFrame([("subject", "topic", True), ("annual_cap", "charge_code", True), ("exceptions", "status", False)], "alias string, canonical string, active boolean")
    got = {r.alias: r.canonical for r in schema.dictionary(spark, o).collect()}
    assert got["subject"] == "topic" and got["annual_cap"] == "charge_code" and got["exceptions"] == "exception_text"


def test_admin_flow(spark):
    df = spark.createDataFrame([("Topic", "if it is late", "call", "approval after 9", "q"), (None, None, None, "vague", None), ("T", None, "do", "approval 1", None)], "topic string, cond string, act string, text string, quote string")
    c = F.col
    conf = publish.admin_confidence(c("topic"), c("cond"), c("act"), c("text"))
    got = df.select(conf.alias("n"), publish.clarifications(c("text"), c("cond")).alias("q"), publish.submission_state(conf, c("topic"), c("act"), c("cond"), c("quote")).alias("s"), publish.missing_fields(c("topic"), c("quote"), c("act"), c("cond")).alias("m")).collect()
    assert [(round(r.n, 2), len(r.q), r.s, len(r.m)) for r in got] == [(1.0, 0, "extracted", 0), (0.0, 3, "needs_clarification", 3), (0.8, 1, "needs_review", 1)]


def test_answers():
    assert profile.answer([]) == profile.NOT_FOUND
    said = profile.answer([{"topic": "T", "subtopic": "S", "summary": "x" * 400}])
    assert "T / S" in said and "..." in said and len(said.splitlines()[1]) <= 260
    full = profile.answer([{"action_text": "Do it", "condition_text": "late", "approval_required": True, "approver": "Kim", "exception_text": "never", "bill_to": "B", "charge_code": "C"}, {"action_text": "do  IT"}])
    assert "Kim" in full and full.count("- Do it") == 1 and "Exception: never" in full and "Bill to: B" in full
    assert [x for x in full.splitlines() if x and not x.startswith("- ")] == ["Direct Answer", "Do it", "Key Details", "Important Notes / Exceptions", "What You Should Do"]
    assert "No approval" in profile.answer([{"approval_required": False, "action_text": "x"}]) and "Exceptions" not in profile.answer([{"action_text": "x"}])


def test_evaluation(spark):
    df = spark.createDataFrame([("q1", "See 1507.2.1 the slate", ["slate", "SEE"], ["the"]), ("q2", "no", ["x"], []), ("q3", None, [], [])], "qid string, a string, must array<string>, nice array<string>")
    scores = df.select("qid", *[v.alias(k) for k, v in profile.eval_scores(F.col("a"), F.col("must"), F.col("nice")).items()])
    assert [(r.accuracy, r.completeness, r.grounding) for r in scores.orderBy("qid").collect()] == [(2, 1, 2), (0, 0, 0), (1, 0, 0)]
    assert profile.eval_aggregate(scores).first().pass_rate == pytest.approx(1 / 3)
    assert profile.eval_aggregate(scores.limit(0)).first().avg_total == 0.0
    assert eval_report(scores).count("\n") == 4


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id int, v array<double>")
    assert [r.id for r in vector.topk(df, [1.0, 0.0], 2, "id", "v").collect()] == [1, 2]
    both = vector.hybrid(df.select("id", F.lit(0.5).alias("score")).limit(1), df.select("id", F.lit(1).alias("score")), "id")
    assert both.count() == 3 and both.filter("id = 1").first().kind == 0


def test_nearest_of_a_table_of_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None), (302, [1.0]), (303, [float("nan")] * 4), (None, [1.0] * 4)]
    rows += [(400 + i, rows[7][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = df.filter("vec_id % 60 = 7 or vec_id in (300, 301, 302) or vec_id is null").withColumnRenamed("vec_id", "q")
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    good = [(i, x) for i, x in rows if i is not None and x is not None and len(x) == 4 and x[0] == x[0] and any(x)]
    for limit in (1000, 2):
        got = {}
        for r in vector.topk_table(df, asked, 6, "vec_id", "v", "q", 4, limit).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.vec_id)
        want = {q: [i for _, i in sorted((-round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 12), i) for i, x in good)[:6]] for q, y in good if q % 60 == 7}
        assert got == want
    assert vector.topk_table(df.limit(0), asked, 6, "vec_id", "v", "q", 4).count() == 0 == vector.topk_table(df, asked.limit(0), 6, "vec_id", "v", "q", 4).count()


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("plain")
    (tmp_path / "a" / "b" / "y.txt").write_text("nested")
    (tmp_path / "a" / "z.bin").write_bytes(b"no")
    assert sorted(r.text for r in files.documents(spark, f"file://{tmp_path}/a").collect()) == ["nested", "plain"]
    rule = {"sec": "1", "title": "t", "version": "v", "items": [{"key": "k", "label": "l", "value": "1", "units": "in", "note": None}]}
    (tmp_path / "r.json").write_text(json.dumps(rule, indent=1))
    assert files.rule_tables(spark, f"file://{tmp_path}/r.json").first().key == "k"
    (tmp_path / "c.json").write_text(json.dumps({"published_rows_all": [{"topic": "T"}, {"topic": "U"}]}))
    assert files.cached_rows(spark, f"file://{tmp_path}/c.json", "topic:string").count() == 2
    three = spark.createDataFrame([(i, 3) for i in (1, 2, 3)], "page int, total int")
    assert [r.page for r in pages.selected(three, [2, 9]).collect()] == [2] and pages.selected(three, [9]).count() == 3
    assert files.local_path("file:///a%20b") == "/a b" and files.local_path("/no/such") is None and files.local_path(str(tmp_path)) == str(tmp_path) and files.local_path(" ") is None
    uris = spark.createDataFrame([("file:///a%20b+c",), ("http://x",), (None,)], "u string")
    assert [r.p for r in uris.select(files.path_of(F.col("u")).alias("p")).collect()] == ["/a b+c", None, None]


def docx(texts):
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["One", " ", "Two"]))
    (tmp_path / "b.docx").write_bytes(b"damaged")
    (tmp_path / "c.docx").write_bytes(docx([" "]))
    (tmp_path / "d.txt").write_text("plain")
    (tmp_path / "e.md").write_text("# marked")
    got = {r.source_uri[-6:]: r for r in files.documents(spark, f"file://{tmp_path}", {"md": bytes.decode}).collect()}
    assert got["a.docx"].text == "One\n\nTwo" and got["a.docx"].error is None and got["/e.md"[-6:] if "/e.md" in got else next(k for k in got if k.endswith("e.md"))].text == "# marked"
    assert got["b.docx"].text is None and got["b.docx"].error and got["c.docx"].error == "ValueError: the document has no text"


def paged():
    """A reader and an engine; inner functions travel to the workers whole."""

    def read_pages(data):
        """Pages of a test file: pages parted by form feeds, blocks by |, an image by a leading !."""
        if data == b"damaged":
            raise ValueError("no pages")
        for i, p in enumerate(data.decode().split("\f"), 1):
            parts = p.split("|")
            yield {"page": i, "blocks": [(float(-n), 0.0, t) for n, t in enumerate(x for x in parts if not x.startswith("!"))], "tables": [[["h", None], ["x", " y "]]] if "table" in p else [], "images": [x[1:].encode() for x in parts if x.startswith("!")]}

    def read_image(data):
        if b"bad" in data:
            raise ValueError("unreadable")
        return data.decode() + "\n"

    return read_pages, read_image


def test_one_file_is_read_by_many_tasks_and_unselected_pages_are_not_decoded(spark, tmp_path):
    (tmp_path / "long.pg").write_text("\f".join(f"page {i}" for i in range(1, 1001)))
    (tmp_path / "short.pg").write_text("one\ftwo\fbad")
    (tmp_path / "damaged.pg").write_bytes(b"damaged")
    (tmp_path / "empty.pg").write_bytes(b"")

    def count(data):
        if data == b"damaged":
            raise ValueError("no pages")
        return data.decode().count("\f") + 1 if data else 0

    def read(data, numbers):
        from pyspark import TaskContext

        parts = data.decode().split("\f")
        for n in numbers:
            if parts[n - 1] == "bad":
                raise ValueError("odd page")
            yield {"page": n, "blocks": [(0.0, 0.0, parts[n - 1]), (1.0, 0.0, str(TaskContext.get().partitionId()))], "tables": [], "images": []}

    kind = pages.Paged(count, read)
    where = f"file://{tmp_path}"
    rows = pages.page_ranges(spark, where, None, kind, "*.pg", size=50).collect()
    mine = {r.page: r for r in rows if r.source.endswith("long.pg")}
    assert sorted(mine) == list(range(1, 1001)) and all(r.blocks[0].text == f"page {n}" and r.total == 1000 for n, r in mine.items())
    assert len({r.blocks[1].text for r in mine.values()}) > 1, "several tasks"
    short = {r.page: r for r in rows if r.source.endswith("short.pg")}
    assert short[1].error is None and short[3].error == "ValueError: odd page" and len(short) == 3
    assert [(r.page, r.total, r.error) for r in rows if r.source.endswith("damaged.pg")] == [(None, 0, "ValueError: no pages")] and not [r for r in rows if r.source.endswith("empty.pg")]
    # page 3 of the short file would fail if it were decoded
    some = pages.page_ranges(spark, where, [2, 777, 5000], kind, "*.pg").collect()
    assert sorted(r.page for r in some if r.page) == [2, 2, 777]
    assert all(r.error is None for r in some if r.page)
    none = pages.page_ranges(spark, where, [5000], kind, "*.pg").filter(F.col("source").endswith("short.pg")).collect()
    assert sorted(r.page for r in none) == [1, 2, 3]


def test_pages(spark, tmp_path):
    read_pages, read_image = paged()
    (tmp_path / "a.pg").write_text("lower line  |upper line here\fa table here\f|!seen in image\nlower|!bad|!second")
    (tmp_path / "b.pg").write_bytes(b"damaged")
    rows = pages.pages(spark, f"file://{tmp_path}", read_pages, "*.pg").persist()
    assert [(r.page, r.error) for r in rows.collect() if r.source.endswith("b.pg")] == [(None, "ValueError: no pages")]
    texts = pages.text_pages(rows)
    by = {r.page: r.text for r in texts.collect()}
    assert by == {1: "upper line here\n\nlower line", 2: "a table here\n\n[Detected Table 1]\n\n| h |  |\n| --- | --- |\n| x | y |"}
    assert pages.text_pages(rows, with_tables=False).filter("page = 2").first().text == "a table here"
    ocr = pages.ocr_pages(pages.image_rows(rows), read_image)
    assert [(r.page, r.ocr_text) for r in ocr.collect()] == [(3, "seen in image\nlower\nsecond")]
    merged = pages.merged_pages(texts, ocr)
    chunks = pages.page_chunks(merged, size=12)
    got = chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(len(got))) and [r.page for r in got] == sorted(r.page for r in got) and all(r.tokens == len(r.text.split()) for r in got)
    stats = {r.page: r for r in pages.statistics(merged).collect()}
    assert stats[2].tables_detected == 1 and stats[1].text_lines == 2 == stats[1].text_lines_covered and stats[3].ocr_lines == 3 and not stats[3].ocr_used
    sinks.chunk_files(chunks, f"file://{tmp_path}/out")
    (made,) = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert [c["chunk_id"] for c in made] == list(range(len(got))) and set(made[0]) == {"chunk_id", "page", "text", "tokens", "source"}
    (tmp_path / "m").mkdir()
    for n in (12, 3):
        (tmp_path / "m" / f"page_{n:04d}_merged.txt").write_text("x")
    assert [r.page for r in pages.listed_pages(spark, f"file://{tmp_path}/m").collect()] == [3, 12]


def test_store_transactions(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    ids = lambda t: sorted(r.id for r in store.read(t).collect())
    assert store.append("a", rows(1, 2)) == 2 and store.append("a", rows(3)) == 1 and ids("a") == [1, 2, 3]
    assert store.insert_many("a", [], "id int") == 0 and store.insert_many("a", [(4,)], "id int") == 1
    assert store.insert_absent("a", rows(4, 5, 5), "id") == 1 and ids("a") == [1, 2, 3, 4, 5]
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.rewrite("a", rows(9))
        store.append("b", rows(9))
        assert ids("a") == [9]
        1 / 0
    assert ids("a") == [1, 2, 3, 4, 5] and store.tables() == ["a"]
    with store.transaction():
        store.rewrite("a", rows(7))
        store.append("b", rows(8))
        assert sinks.Store(spark, store.root).tables() == ["a"]
    assert ids("a") == [7] and ids("b") == [8]
    other = sinks.Store(spark, store.root)
    with pytest.raises(sinks.Conflict), store.transaction():
        store.append("a", rows(10))
        other.append("a", rows(11))
    assert ids("a") == [7, 11] and store.create({"a": "id int", "c": "id int, t string"}) == ["c"]
    assert store.snapshot()["c"] == {"id": "int", "t": "string"}
    assert store.vacuum(keep=1) == 0, "folders of today stay"
    assert store.vacuum(keep=1, hours=0) > 0 and ids("a") == [7, 11] and store.vacuum(keep=1, hours=0) == 0
    assert sinks.run_script(spark, "-- a comment\nCREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS x;\n\nCREATE OR REPLACE TEMP VIEW v2 AS SELECT ';' AS y;\n", ["v1", "v2", "v3"]) == ["v3"]


def test_store_with_two_writers(spark, tmp_path):
    one, two = (sinks.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    with one.transaction():
        one.append("a", rows(1))
        assert two.vacuum() == 0
    assert one.read("a").count() == 1
    # a vacuum that spares nothing: the commit notices
    with pytest.raises(sinks.Conflict), one.transaction():
        one.append("a", rows(2))
        two.vacuum(hours=-1)
    assert [r.id for r in two.read("a").collect()] == [1]
    # of many writers that claim one number only one may write it
    assert [one._claim(7), two._claim(7), one._claim(7)] == [True, False, False]
    # a claim whose writer died is taken over once it is old
    assert two._claim(2)
    with pytest.raises(sinks.Conflict):
        one.append("a", rows(3))
    one.CLAIM_S = -1
    assert one.append("a", rows(3)) == 1 and sorted(r.id for r in two.read("a").collect()) == [1, 3]
    two.write_parts("p", spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, k string"), "k", lambda v: f"p_{v}", add=True)
    assert sorted(r.id for r in one.read("p_x").collect()) == [1, 3] and two.vacuum(keep=1, hours=-1) == 0 and one.read("p_y").first().id == 2


def test_schema_changes_end_to_end(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    batch = pipeline.create_batch(store, "tests")
    pipeline.ingest_batch(store, batch, inputs(spark, "# Odd\nIf a form is late you must note the vendor_required field.\n"))
    asked = pipeline.plan_changes(spark, store, batch).collect()
    assert [(r.migration_class, [i.concept for i in r["items"]]) for r in asked] == [("approval_required", ["vendor_required"])]
    assert pipeline.apply_changes(store)[0]["status"] == "skipped" and store.read("schema_migration_log").count() == 0
    pipeline.decide(store, [r.request_id for r in asked], "approved", "kim", "fine")
    store.rewrite("schema_change_requests", store.read("schema_change_requests").withColumn("items", F.transform("items", lambda i: i.withField("gap_type", F.lit("new_scalar")))))
    assert pipeline.apply_changes(store)[0]["columns"] == ["vendor_required"] and "vendor_required" in store.columns("policies")
    log = store.read("schema_migration_log").first()
    assert log.status == "applied" and log.applied_at is not None and pipeline.apply_changes(store) == []
    with pytest.raises(ValueError):
        pipeline.decide(store, [], "perhaps", "kim")
    pipeline.publish_batch(store, batch)
    assert store.read("policies").filter("status = 'active'").count() == 1


def test_admin_publication(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    item = lambda **k: tuple(k.get(f) for f in ("topic", "subtopic", "condition_text", "action_text", "source_quote"))
    made = spark.createDataFrame([
        ("s1", "Needs approval above 9", item(topic="Travel", condition_text="if abroad", action_text="ask", source_quote="q"), "ann", None, None, None, None),
        ("s2", "vague", item(), "ann", None, None, None, None), ("s3", "text", None, "ann", None, None, None, None),
    ], admin.SUBMISSION)
    judged = admin.judged(made)
    state = {r.id: (r.status, len(r.questions), len(r.missing)) for r in judged.collect()}
    assert state["s1"] == ("extracted", 0, 0) and state["s2"] == ("needs_clarification", 3, 3)
    refused = {r.id: r.reason for r in pipeline.publish_submissions(store, judged, "kim").collect()}
    assert refused == {"s2": "status needs_clarification", "s3": "nothing was extracted"}
    assert [r.topic for r in store.read("policies").collect()] == ["Travel"]
    (log,) = store.read("admin_audit").collect()
    assert log.submission_id == "s1" and log.version == 1 and json.loads(log.final_json)["action_text"] == "ask" and log.published_at is not None
    pipeline.publish_submissions(store, judged, "kim")
    assert store.read("policies").count() == 1 == store.read("admin_audit").count()


def test_models_and_fallbacks(spark, tmp_path):
    assert models.unfenced("```json\n{\"a\": 1}\n```") == '{"a": 1}' and models.unfenced(" x ") == "x" and models.unfenced("```\nx") == "x"
    with pytest.raises(ValueError):
        models.parsed("```\n```")
    with pytest.raises(ValueError):
        models.parsed("{")
    fences = spark.createDataFrame([("```json\n{}\n```",), (" plain ",), (None,), ("```\nx",)], "t string")
    assert [r.x for r in fences.select(text.fence_stripped(F.col("t")).alias("x")).collect()] == ["{}", "plain", "", "x"]
    rules = spark.createDataFrame([("p1", "Travel Abroad", "active"), ("p2", "Travel", "active"), ("p3", " ", None)], "policy_id string, topic string, status string")
    told = models.context(rules)
    assert told.splitlines() == ["rows: 3", "status: active", "topic: Travel", "topic: Travel Abroad"] and models.context(rules.limit(0)) == "rows: 0"
    assert models.planned("What about travel abroad?", None, told).filters["topic"] == "Travel Abroad"
    plan = models.planned("What are the holidays?", lambda q, c: '```json\n{"table": "policies_v2", "filters": {"topic": "Holidays", "department": "x"}}\n```')
    assert plan.intent == "complete_list" and "department" not in plan.filters
    calls, now = [], [0.0]
    cached = models.Cached(lambda: calls.append(1) or str(len(calls)), 300, lambda: now[0])
    assert cached() == cached() == "1"
    now[0] = 301
    assert cached() == "2"
    sections = spark.createDataFrame([("good",), ("fails",), ("[1]",)], "section_text string")
    out = {r.section_text: r.model for r in models.extracted(sections, lambda t: json.dumps({"topic": t}) if t == "good" else t).collect()}
    assert out["good"].topic == "good" and out["fails"] is None and out["[1]"] is None
    whole = "Direct Answer\nYes.\n\nKey Details\n- a\n\nWhat You Should Do\n- b"
    row = {"topic": "Time", "subtopic": "Social", "action_text": "Log setup only.", "source_quote": "It is voluntary.", "approval_required": "true"}
    assert models.formatted("q", [row], "i", lambda q, r, i: whole) == whole
    told = models.formatted("q", [row], "i", lambda q, r, i: "Yes, it needs approval.\nAsk first.\nDetails:")
    assert told.startswith("Direct Answer\nYes, it needs approval. Ask first.") and "Key Details" in told and "- Log setup only." in told
    related = models.formatted("q", [row], "i", lambda q, r, i: f"{profile.NOT_FOUND}.")
    assert profile.RELATED in related and "- Time / Social: Log setup only." in related and profile.NOT_FOUND not in related
    assert profile.RELATED_BLANK in models.formatted("q", [{"topic": "x"}], "i", lambda q, r, i: profile.NOT_FOUND)
    assert "x" in models.formatted("q", [{"action_text": "x"}], "i", lambda q, r, i: 1 / 0)
    assert models.formatted("q", [], "i", lambda q, r, i: "told") == profile.NOT_FOUND
    pairs = models.topic_mapping(spark, rules, lambda known: {known[0][0]: "T", "unknown": "x", "Travel Abroad": " "}).collect()
    assert len(pairs) == 1 and pairs[0].canonical == "T"
    vectors = models.embedded(spark.createDataFrame([("a",), (" ",), ("bb",)], "text string").coalesce(1), lambda texts: [[len(t)] for t in texts], batch=1).collect()
    assert [r.embedding for r in vectors] == [[1.0], None, [2.0]]
    lost = Store(spark, f"file://{tmp_path}/nowhere")
    cache = spark.createDataFrame([("p1", "Travel", "Book early"), ("p2", "Food", "Eat")], "policy_id string, topic string, action_text string")
    got = pipeline.ask(lost, "How early do I travel?", {"table": "policies_v2", "filters": {}}, cache=cache)
    assert got["source"] == "cache" and got["error"] and [r["policy_id"] for r in got["rows"]] == ["p1"] and "Book early" in got["answer"]
    with pytest.raises(Exception):  # noqa: B017
        pipeline.ask(lost, "How?", {"table": "policies_v2", "filters": {}})
    assert pipeline.snapshot_context(lost)() == ""
    with pytest.raises(ValueError):
        pipeline.ask(lost, "  ")


def test_small_operators(spark):
    assert spec.question_class("Internal marketing on the weekend") == {"policy_category": "marketing", "activity_type": "internal marketing"} and spec.question_class(None) == {"policy_category": "billing", "activity_type": None}
    plan = spec.SearchSpec({"activity_type": "x", "status": "active"})
    assert spec.relaxed_once(plan).filters == {"status": "active"} and spec.relaxed_once(spec.SearchSpec({"status": "active"})) is None
    df = spark.createDataFrame([(1, Decimal("1.50"), datetime(2024, 1, 2), bytearray(b"x"), [1.0])], "i int, d decimal(5,2), t timestamp, b binary, v array<double>")
    row = profile.json_rows(df).first()
    assert json.loads(json.dumps(row.asDict()))["d"] == "1.50" and row.t.startswith("2024-01-02") and row.i == 1
    look = profile.preview(spark.createDataFrame([("x" * 200, [1.0, 2.0])], "content string, embedding array<double>")).first()
    assert len(look.content) == 100 and look.embedding == 2
    bad = [({"": ("v", "string", 0.5, "p")}, []), ({"a": ("v", "string", 1.5, "p")}, []), ({}, [("", None, None, None, 1)]), ({}, [("x", None, None, None, 0)]), ({"a": ("v", "string", 1.0, "p")}, [("x", None, None, None, 1)]), (None, None)]
    got = [r.e for r in spark.createDataFrame(bad, f"mapped_fields {schema.MAPPED}, unmapped_concepts {schema.UNMAPPED}").select(publish.payload_error().alias("e")).collect()]
    assert [bool(e) for e in got] == [True, True, True, True, False, False]
    with pytest.raises(ValueError):
        search.project(df, spec.SearchSpec(fields=("i; drop",)))
    rows = vector.vector_rows(spark.createDataFrame([("c1", "a b c", [1.0])], "chunk_id string, content string, embedding array<double>"), "local", "m")
    assert len(rows.columns) == 18 and rows.first().word_count == 3 and rows.first().char_count == 5 and rows.first().embedding == [1.0]
    texts = spark.createDataFrame([("\n\n".join(" ".join(["w"] * n) for n in (100, 60, 50, 30)),), ("one two",), ("",), (None,)], "t string")
    sizes = [[len(c.split()) for c in r.c] for r in texts.select(text.paragraph_chunks(F.col("t")).alias("c")).collect()]
    assert sizes == [[160 + 80], [2], [], []]
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(520)),)], "t string")
    assert [len(c.split()) for c in long.select(text.word_chunks(F.col("t"), 500, 80, 101).alias("c")).first().c] == [500] and len(long.select(text.word_chunks(F.col("t"), 500, 80, 50).alias("c")).first().c) == 2
    hints, aliases, reserved = schema.read_dictionary("concepts:\n  cost: {type_hint: numeric, synonyms: [Price], reserved_names: [Total]}\n  area:\nmapping_rules: {fee: cost}\n")
    assert hints == {"cost": "numeric", "area": "text"} and aliases == {"price": "cost", "fee": "cost"} and reserved == {"total"}
    assert {(r.alias, r.canonical, r.type_hint) for r in schema.dictionary(spark, None, hints, aliases).collect()} == {("cost", "cost", "numeric"), ("area", "area", "text"), ("price", "cost", "numeric"), ("fee", "cost", "numeric")}


def test_mirror(spark, tmp_path):
    rows = [("1", "p", "b", "published", "2024-01-01 00:00:00", "{}"), ("1", "p", "b", "published", "2024-01-01 00:00:00", "{}"), ("2", "p", "b", "changed", "2024-01-01 01:00:00", "{2}"), ("3", " ", "b", "published", "2024-01-01 00:00:00", "{}")]
    spark.createDataFrame(rows, "event_id string, policy_id string, batch_id string, event_type string, event_time string, payload_json string").withColumn("event_time", F.to_timestamp("event_time")).write.parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/out")
    for _ in range(2):
        mirror.start(spark.readStream.schema(mirror.EVENT).parquet(f"file://{tmp_path}/in"), store, f"file://{tmp_path}/cp").awaitTermination(120)
    assert store.read("policy_events").count() == 3
    assert [(r.policy_id, r.payload_json) for r in mirror.current(store).collect()] == [("p", "{2}")]


def test_mirror_keeps_late_events(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/out")
    for i, (event, hour) in enumerate([("1", 9), ("2", 10), ("3", 4), ("3", 4)]):
        spark.createDataFrame([(event, "p", "b", "changed", f"2024-01-01 {hour:02d}:00:00", "{%s}" % event)], "event_id string, policy_id string, batch_id string, event_type string, event_time string, payload_json string").withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        mirror.start(spark.readStream.schema(mirror.EVENT).parquet(f"file://{tmp_path}/in"), store, f"file://{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.event_id for r in store.read("policy_events").collect()) == ["1", "2", "3"]
    assert [r.payload_json for r in mirror.current(store).collect()] == ["{2}"]


def test_mirror_reads_the_days_of_a_batch_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/out")

    def come(*events):
        rows = [(e, p, "b", "changed", t, "{%s}" % e) for e, p, t in events]
        spark.createDataFrame(rows, "event_id string, policy_id string, batch_id string, event_type string, event_time string, payload_json string").withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        mirror.start(spark.readStream.schema(mirror.EVENT).parquet(f"file://{tmp_path}/in"), store, f"file://{tmp_path}/cp").awaitTermination(120)

    come(*[(f"e{d}", f"p{d}", f"2024-01-{d:02d} 08:00:00") for d in range(1, 9)], ("odd", "p1", None))
    # the past goes away; whoever reads it fails
    for folder in store._now()["policy_events"]:
        if not folder.endswith(("_day=20240108", "_day=none")):
            store._delete([folder])
    come(("e8", "p8", "2024-01-08 08:00:00"), ("new", "p8", "2024-01-08 09:00:00"), ("late", "p8", "2024-01-08 01:00:00"), ("odd", "p1", None))
    got = store.read("policy_events", {"_day=20240108", "_day=none"})
    assert sorted(r.event_id for r in got.collect()) == ["e8", "late", "new", "odd"]
    assert {r.policy_id: r.payload_json for r in mirror.current(store).collect()} == {f"p{d}": "{e%d}" % d for d in range(1, 8)} | {"p8": "{new}"}


def test_rename_is_atomic(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "topic string")
    out, changed = ingest.renamed(df, "topic", spark.createDataFrame([("a", "b"), ("b", "c")], "original string, canonical string"))
    assert sorted(str(r.topic) for r in out.collect()) == ["None", "b", "c"] and changed.count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(RULES)
    (tmp_path / "in" / "b.docx").write_bytes(b"damaged")
    run = lambda *a: command_line([f"file://{tmp_path}/store", *a], spark)
    assert run("status") == {"tables": {}}
    made = run("ingest", f"file://{tmp_path}/in", "--no-publish")
    assert made["extractions"] == 3 and len(made["unreadable"]) == 1 and run("changes") == []
    assert [(r["published"], r["skipped"]) for r in run("publish", "--batch", made["batch_id"])] == [(2, 1)]
    told = run("status", "--sample", "--failed")
    assert told["staging"] == {"published": 2, "skipped": 1} and len(told["sample"]) == 2 and len(told["failed"]) == 1
    assert "May Day" in run("ask", "What are all the holidays?") and run("ask", "holidays", "--json")["source"] == "rules"
    assert "Direct Answer" in capsys.readouterr().out


def test_chunks_are_numbered_by_blocks_of_pages(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGE_BLOCK", 2)
    rows = [("a", p, "w " * (p % 4)) for p in range(11)] + [("b", None, "x y"), ("b", 3, "z"), ("b", 3, "z"), (None, 1, "q r")]
    got = pages.page_chunks(spark.createDataFrame(rows, "source string, page long, merged string"), size=1).collect()
    for source in ("a", "b", None):
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.chunk_id)
        assert [r.chunk_id for r in mine] == list(range(len(mine)))
        assert [(r.page, r.text) for r in mine] == [(p, w) for s, p, t in rows if s == source for w in t.split()]


def test_global_chunk_ids_reads_documents():
    assert "FROM documents" in catalogue.ORACLES["global_chunk_ids"]
