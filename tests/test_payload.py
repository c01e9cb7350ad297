"""Payloads as VARIANT: typed reads, reasons for what cannot be read, and what publication makes of them."""

import pytest
from pyspark.sql import functions as F

from rulespark import pipeline
from rulespark.functions import payload
from rulespark.operators import publish
from rulespark.sources.sinks import Store
from rulespark.streaming import mirror


def column(spark, values, make):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "t string").select(make(F.col("t")).alias("x")).collect()]


def test_booleans_and_numbers(spark):
    texts = ["true", " YES ", "1", "T", "false", "No", "0", "f", "maybe", "", None, "2"]
    assert column(spark, texts, payload.boolean) == [True] * 4 + [False] * 4 + [None] * 4
    texts = ["5000", " 5,000 ", "$1,234,567.50", "€ 3", "-2.5", ".5", "1e3", "7.", "1,2", "1,2345", "5 000", "NaN", "Infinity", "1e999", "12d", "x", "", None]
    assert column(spark, texts, payload.number) == [5000.0, 5000.0, 1234567.5, 3.0, -2.5, 0.5, 1000.0, 7.0] + [None] * 10


def test_payloads_and_reasons(spark):
    rows = [
        ('{"flag": true, "cap": 12.5, "who": " Ann ", "deep": {"a": [1]}}', None, (True, 12.5, "Ann", '{"a":[1]}'), []),
        (' \n{"flag": "no", "cap": "1,000", "who": null}', None, (False, 1000.0, None, None), []),
        ('{"flag": "maybe", "cap": [1], "who": 7, "deep": ""}', None, (None, None, "7", None), [("flag", "maybe", "not a boolean"), ("cap", "[1]", "not a double")]),
        ("{}", None, (None,) * 4, []),
        ('{"flag": true', "not JSON", (None,) * 4, []),
        ('{"flag": true, "flag": false}', "not JSON", (None,) * 4, []),
        ('["flag"]', "not an object", (None,) * 4, []),
        ("null", "not an object", (None,) * 4, []),
        ("  ", "blank", (None,) * 4, []),
        (None, None, (None,) * 4, []),
        ('{"who": "' + "x" * 3_000_000 + '", "cap": 1}', None, (None, 1.0, "x" * 3_000_000, None), []),
    ]
    df = spark.createDataFrame([(i, t, "old") for i, (t, *_) in enumerate(rows)], "i int, body string, flag string")
    got = {r.i: r for r in payload.read(df, "body", {"flag": "bool", "cap": "numeric", "who": "text", "deep": "text"}).collect()}
    for i, (_, error, fields, wrong) in enumerate(rows):
        assert (got[i].payload_error, (got[i].flag, got[i].cap, got[i].who, got[i].deep), [tuple(e) for e in got[i].field_errors]) == (error, fields, wrong), i
    assert payload.read(df.limit(0), "body", {"cap": "numeric"}).collect() == []
    odd = spark.createDataFrame([('{"a b": 1, "it\'s": "t"}',)], "body string")
    assert tuple(payload.read(odd, "body", {"a b": "numeric", "it's": "bool"}).select("a b", "it's").first()) == (1.0, True)
    with pytest.raises(ValueError):
        payload.place("'\"")


def test_published_payload(spark):
    kind = "extraction_id string, section_id string, candidate struct<candidate_id:string,publishable:boolean,confidence:double,topic:string,subtopic:string,condition_text:string,action_text:string,recommendation_text:string,summary:string,reason_if_not_publishable:string,source_quote:string>, mapped_fields map<string,struct<value:string,value_type:string>>, confidence double, status string"
    candidate = ("c", True, 0.9, "T", None, None, None, None, None, None, "q")
    mapped = {"topic": ("T", "string"), "is_billable": ("yes", "string"), "amount_threshold": ("much", "numeric"), "floors": ("3", "numeric"), "deadline_text": (None, "string")}
    staged = spark.createDataFrame([("e1", "s", candidate, mapped, 0.9, "pending"), ("e2", "s", candidate, None, 0.9, "pending"), ("e3", "s", candidate, {}, 0.9, "pending")], kind)
    rules = publish.published(staged, ["topic", "amount_threshold", "payload"])
    out = {r.extraction_id: r for r in rules.withColumn("json", F.to_json("payload")).drop("payload").collect()}
    assert out["e1"].json == '{"amount_threshold":"much","floors":3.0,"is_billable":true,"topic":"T"}' and out["e2"].json == out["e3"].json == "{}"
    assert out["e1"].topic == "T" and out["e1"].amount_threshold == "much"
    one = publish.typed(rules).filter("extraction_id = 'e1'").first()
    assert one.is_billable is True and one.amount_threshold is None and [tuple(e) for e in one.field_errors] == [("amount_threshold", "much", "not a double")]
    # a table without payloads has its columns typed, and no others
    plain = publish.typed(spark.createDataFrame([("p", "no", "12")], "policy_id string, is_billable string, amount_threshold string"))
    assert tuple(plain.drop("field_errors").first()) == ("p", False, 12.0) and plain.first().field_errors == []


def test_rules_come_back_typed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    text = "1.1 Travel Policy\nEmployees must obtain approval before billable travel. The annual cap is 5,000 per year for every employee of the firm. If travel exceeds this, managers must approve it."
    made = pipeline.create_batch(store, "t")
    pipeline.ingest_batch(store, made, spark.createDataFrame([("a.txt", text, "A", "text", 1)], "source_uri string, raw_content string, title string, doc_type string, seq int"))
    pipeline.publish_batch(store, made)
    assert dict(store.read("policies").dtypes)["payload"] == "variant"
    rules = pipeline.typed_rules(store)
    assert {k: v for k, v in rules.dtypes if k in ("is_billable", "approval_required", "amount_threshold")} == {"is_billable": "boolean", "approval_required": "boolean", "amount_threshold": "double"}
    row = rules.drop("payload").first()
    assert (row.is_billable, row.approval_required, row.amount_threshold, row.field_errors) == (True, True, 5000.0, [])
    # publishing again, and reading and asking over it, go on as before
    pipeline.publish_batch(store, made)
    assert store.read("policies").count() == 1 and pipeline.ask(store, "What about travel approval?", {"table": "policies_v2", "filters": {}})["rows_found"] == 1


def test_current_state_by_field(spark, tmp_path):
    rows = [("1", "p", "2024-01-01 00:00:00", '{"cap": "1"}'), ("2", "p", "2024-01-01 01:00:00", '{"cap": "2,000"}'), ("3", "q", "2024-01-01 00:00:00", "{")]
    events = spark.createDataFrame(rows, "event_id string, policy_id string, event_time string, payload_json string").select("event_id", "policy_id", F.lit("b").alias("batch_id"), F.lit("changed").alias("event_type"), F.to_timestamp("event_time").alias("event_time"), "payload_json")
    events.write.parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/out")
    assert mirror.current_fields(store, {"cap": "numeric"}) is None
    mirror.start(spark.readStream.schema(mirror.EVENT).parquet(f"file://{tmp_path}/in"), store, f"file://{tmp_path}/cp").awaitTermination(120)
    assert {r.policy_id: (r.cap, r.payload_error) for r in mirror.current_fields(store, {"cap": "numeric"}).collect()} == {"p": (2000.0, None), "q": (None, "not JSON")}
