"""The publish gate, published rows, audit and batch counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions import payload as P
from rulespark.schema import TYPE_HINTS

from .ingest import key_id, latest_per_key

STRUCTURE = ("topic", "subtopic", "condition_text", "action_text", "recommendation_text", "summary")


def payload_error(mapped: str = "mapped_fields", unmapped: str = "unmapped_concepts") -> Column:
    """Why a staged payload breaks its contract, or null: blank keys, confidences outside 0 to 1, frequencies under 1."""
    keys, values = F.map_keys(mapped), F.map_values(mapped)
    bad = lambda c: F.coalesce(F.exists(c, lambda x: ~x["confidence"].between(0, 1)), F.lit(False))
    return (
        F.when(F.coalesce(F.exists(keys, lambda k: F.trim(k) == ""), F.lit(False)), "a mapped field has no name")
        .when(bad(values), "a mapped field's confidence is outside 0 to 1")
        .when(F.coalesce(F.exists(unmapped, lambda u: F.trim(F.coalesce(u["raw_label"], F.lit(""))) == ""), F.lit(False)), "an unmapped concept has no label")
        .when(F.coalesce(F.exists(unmapped, lambda u: u["frequency_in_batch"] < 1), F.lit(False)), "an unmapped concept's frequency is under 1")
    )


def contract_error(c: str = "candidate") -> Column:
    """Why a candidate breaks its contract, or null."""
    f = lambda n: F.col(f"{c}.{n}")
    return F.when(F.col(c).isNull(), "no candidate").when(F.coalesce(f("candidate_id"), F.lit("")) == "", "no candidate_id").when(f("confidence").isNotNull() & ~f("confidence").between(0, 1), "confidence outside 0 to 1").when(f("publishable").isNull(), "publishable is missing")


def has_payload(staged: DataFrame) -> bool:
    """Whether the table has the whole payload, so that its contract can be held against it."""
    kinds = dict(staged.dtypes)
    return "confidence" in kinds.get("mapped_fields", "") and "frequency_in_batch" in kinds.get("unmapped_concepts", "")


def skip_reason(candidate: str = "candidate", confidence: str = "confidence", payload: bool = False) -> Column:
    """Why a staged row is not published, or null: contract, flag, confidence (0 falls to the row's), structure.

    With ``payload`` the contract of mapped fields and unmapped concepts is part of it.
    """
    f = lambda n: F.col(f"{candidate}.{n}")
    score = F.coalesce(F.nullif(f("confidence"), F.lit(0.0)), F.col(confidence), F.lit(0.0))
    shaped = F.coalesce(*[F.nullif(f(n), F.lit("")) for n in STRUCTURE]).isNotNull()
    broken = contract_error(candidate)
    out = F.when(broken.isNotNull(), F.concat(F.lit("invalid candidate contract: "), broken))
    if payload:
        out = out.when(payload_error().isNotNull(), F.concat(F.lit("invalid payload contract: "), payload_error()))
    return out.when(~f("publishable"), F.coalesce(f("reason_if_not_publishable"), F.lit("chunk flagged non-publishable"))).when(score < 0.5, F.concat(F.lit("confidence below threshold ("), F.format_number(score, 2), F.lit(")"))).when(~shaped, "missing meaningful structured fields")


def payload(staged: DataFrame, hints: dict[str, str] | None = None) -> Column:
    """All mapped fields of a staged row as one VARIANT object, each by its type: its concept's hint, else the type it was mapped with.

    Fields without a column are part of it. Null fields are left out; no mapped fields give an empty object.
    """
    named = {h: [n for n, x in (TYPE_HINTS if hints is None else hints).items() if x == h] for h in P.KINDS}
    tagged = "value_type" in dict(staged.dtypes)["mapped_fields"]
    kind = lambda k, v: F.when(k.isin(*named["bool"]), "bool").when(k.isin(*named["numeric"]), "numeric").otherwise(v["value_type"] if tagged else F.lit(None).cast("string"))
    filled = F.map_filter("mapped_fields", lambda _, v: v["value"].isNotNull())
    return F.to_variant_object(F.transform_values(F.coalesce(filled, F.create_map().cast(dict(staged.dtypes)["mapped_fields"])), lambda k, v: P.held(v["value"], kind(k, v))))


def typed(rules: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """Rules whose columns with the hint bool are booleans and those with the hint numeric doubles, with ``field_errors``.

    The text columns of the table stay as they are in it; here a value that its type cannot hold is null
    and an error (field, value, reason). A field without a column is read from the row's payload.
    """
    kinds = dict(rules.dtypes)
    wanted = {n: h for n, h in (TYPE_HINTS if hints is None else hints).items() if h in P.KINDS}
    spoken = lambda n: [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit(""))] if n in kinds else []
    kept = lambda n: [P.text_of(F.col("payload"), n)] if kinds.get("payload") == "variant" else []
    texts = {n: F.coalesce(*spoken(n), *kept(n), F.lit(None).cast("string")) for n in wanted if n in kinds or kinds.get("payload") == "variant"}
    listed = [(n, t, P.typed(t, wanted[n]), wanted[n]) for n, t in texts.items()]
    return rules.withColumns({n: v for n, _, v, _ in listed} | {"field_errors": P.faults(listed)})


def published(staged: DataFrame, columns: list[str]) -> DataFrame:
    """Rule rows of the rows that pass, one an extraction: known mapped columns, section, quote, status and the typed payload."""
    ok = latest_per_key(staged.filter(skip_reason(payload=has_payload(staged)).isNull() & F.col("status").isin(*OPEN)), ["extraction_id"], [F.desc("confidence"), "section_id"])
    mapped = [c for c in columns if c not in ("policy_id", "section_id", "source_quote", "status", "payload")]
    return ok.select(key_id("pol", F.col("extraction_id")).alias("policy_id"), "extraction_id", "section_id", *[F.col("mapped_fields")[c]["value"].alias(c) for c in mapped], F.coalesce("candidate.source_quote", F.lit("")).alias("source_quote"), F.lit("active").alias("status"), payload(ok).alias("payload"))


OPEN = ("pending", "blocked_schema")


def pending(staged: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Rows that are still to be published, first come first; ids settle equal times."""
    rows = staged.filter(F.col("status").isin(*OPEN))
    return (rows if batch_id is None else rows.filter(F.col("batch_id") == batch_id)).orderBy("created_at", "extraction_id")


def decided(staged: DataFrame, batch_id: str | None = None, now: Column | None = None) -> DataFrame:
    """Staged rows with their status after a publish run over a batch or all; others keep theirs."""
    open_ = F.col("status").isin(*OPEN) & (F.lit(True) if batch_id is None else F.col("batch_id") == batch_id)
    why = skip_reason(payload=has_payload(staged))
    have = lambda c, kind: F.col(c) if c in staged.columns else F.lit(None).cast(kind)
    return staged.withColumns({
        "publish_error": F.when(open_, why).otherwise(have("publish_error", "string")),
        "updated_at": F.when(open_, F.current_timestamp() if now is None else now).otherwise(have("updated_at", "timestamp")),
        "status": F.when(open_ & why.isNull(), "published").when(open_, "skipped").otherwise(F.col("status")),
    })


def audit(rules: DataFrame, now: Column | None = None) -> DataFrame:
    return rules.select(key_id("pub", F.col("extraction_id")).alias("publish_id"), "extraction_id", "policy_id", F.lit("published").alias("publish_status"), F.lit(None).cast("string").alias("error_text"), (F.current_timestamp() if now is None else now).alias("created_at"))


STATES = ("pending", "published", "skipped", "failed")


def batch_counters(staged: DataFrame, key: str = "batch_id", status: str = "status", states: tuple[str, ...] = STATES) -> DataFrame:
    """Per batch the rows in each status; counters are derived, never updated."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col(status) == s, 1).otherwise(0)), F.lit(0)).alias(s)
    return staged.groupBy(key).agg(F.count("*").alias("total"), *[n(s) for s in states])


BATCH = "batch_id string, triggered_by string, trigger_source string, status string, documents_total long, documents_processed long, sections_total long, extractions_total long, result_summary string, started_at timestamp, finished_at timestamp"


def batch_row(spark: SparkSession, batch_id: str, triggered_by: str, trigger_source: str = "manual", now: Column | None = None) -> DataFrame:
    """The row of a batch that begins."""
    empty = spark.createDataFrame([(batch_id, triggered_by, trigger_source, "running", None, None, None, None, None, None, None)], BATCH)
    return empty.withColumn("started_at", F.current_timestamp() if now is None else now)


def batch_totals(batches: DataFrame, documents: DataFrame, sections: DataFrame, staged: DataFrame) -> DataFrame:
    """Batches with their numbers of documents, sections and extractions, counted from the tables."""
    count = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
    out = batches.drop("documents_total", "documents_processed", "sections_total", "extractions_total")
    for df, name in ((documents, "documents_total"), (sections, "sections_total"), (staged, "extractions_total")):
        out = out.join(count(df, name), "batch_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("documents_processed", F.col("documents_total")).select(*batches.columns)


def batch_completion(batches: DataFrame, counters: DataFrame, now: Column | None = None) -> DataFrame:
    """Batches with counters become completed, with the counters as a JSON summary; others stay."""
    done = counters.select("batch_id", F.to_json(F.struct("total", *STATES)).alias("_summary"))
    hit = F.col("_summary").isNotNull()
    out = batches.join(done, "batch_id", "left").withColumns({"status": F.when(hit, "completed").otherwise(F.col("status")), "finished_at": F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col("finished_at")), "result_summary": F.coalesce("_summary", "result_summary")})
    return out.select(*batches.columns)


def current_state(events: DataFrame) -> DataFrame:
    """The latest payload of each policy; blank ids are left out."""
    return latest_per_key(events.filter("trim(policy_id) <> ''"), ["policy_id"], [F.desc("event_time"), F.desc("event_id")]).select("policy_id", "payload_json", F.col("event_time").alias("updated_at"))


def admin_confidence(topic: Column, condition: Column, action: Column, text: Column) -> Column:
    """A fifth each for topic, condition, action, the word approval and a digit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = [F.coalesce(topic, F.lit("")) != "", F.coalesce(condition, F.lit("")) != "", F.coalesce(action, F.lit("")) != "", low.contains("approval"), low.rlike("[0-9]")]
    total = F.lit(0)
    for p in points:
        total = total + p.cast("int")
    return total / 5


def clarifications(text: Column, condition: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(F.when(~low.contains("approval"), "Is approval needed, and who gives it?"), F.when(F.length(F.coalesce(condition, F.lit(""))) < 8, "Which conditions or limits apply?"), F.when(~low.rlike("[0-9]"), "Which amount or number is the limit?")))


def submission_state(confidence: Column, topic: Column, action: Column, condition: Column, quote: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when((confidence < 0.7) | ~has(topic) | ~has(action), "needs_clarification").when(~has(quote) | (~has(action) & ~has(condition)), "needs_review").otherwise("extracted")


def missing_fields(topic: Column, quote: Column, action: Column, condition: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.array_compact(F.array(F.when(~has(topic), "topic"), F.when(~has(quote), "source_quote"), F.when(~has(action) & ~has(condition), "action_text or condition_text")))
