"""Decisions on change requests, and rules that administrators submit by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import publish
from .ingest import key_id

DECISIONS = ("approved", "rejected")
PUBLISHABLE = ("extracted", "needs_review")

SUBMISSION = (
    "id string, raw_text string, item struct<topic:string,subtopic:string,condition_text:string,action_text:string,source_quote:string>, "
    "submitted_by string, source_type string, version int, replaces_policy_id string, created_at timestamp"
)


def decided(requests: DataFrame, ids: list[str], decision: str, reviewer: str, note: str = "", now: Column | None = None) -> DataFrame:
    """The requests with a decision on the given ids; all others as they were."""
    if decision not in DECISIONS:
        raise ValueError(f"a decision is one of {DECISIONS}, not {decision!r}")
    now = F.current_timestamp() if now is None else now
    hit = F.col("request_id").isin(*ids) if ids else F.lit(False)
    new = {"decision_status": F.lit(decision), "reviewer": F.lit(reviewer), "decision_note": F.lit(note), "decided_at": now, "updated_at": now}
    kinds = dict(requests.dtypes)
    kept = lambda c: F.col(c) if c in kinds else F.lit(None)
    return requests.withColumns({c: F.when(hit, v).otherwise(kept(c)) for c, v in new.items()})


def judged(submissions: DataFrame) -> DataFrame:
    """Submissions with confidence, questions, missing fields and status, by the rules of ``publish``."""
    f = lambda n: F.col(f"item.{n}")
    out = submissions.withColumn("confidence", publish.admin_confidence(f("topic"), f("condition_text"), f("action_text"), F.col("raw_text")))
    state = publish.submission_state(F.col("confidence"), f("topic"), f("action_text"), f("condition_text"), f("source_quote"))
    return out.withColumns({"questions": publish.clarifications(F.col("raw_text"), f("condition_text")), "missing": publish.missing_fields(f("topic"), f("source_quote"), f("action_text"), f("condition_text")), "status": state})


def published(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, refused) of judged submissions.

    A rule has the five fields of its item, an active status and the submission's id; its topic falls
    back to General and its quote to the text. Refused are those without an item or in another state,
    with the reason.
    """
    why = F.when(F.col("item").isNull(), "nothing was extracted").when(~F.coalesce(F.col("status").isin(*PUBLISHABLE), F.lit(False)), F.concat(F.lit("status "), F.coalesce("status", F.lit("unknown"))))
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    rules = submissions.filter(why.isNull()).select(
        key_id("pol", F.lit("admin"), F.col("id")).alias("policy_id"), F.col("id").alias("submission_id"), blank("item.topic", F.lit("General")).alias("topic"),
        "item.subtopic", "item.condition_text", "item.action_text", blank("item.source_quote", F.col("raw_text")).alias("source_quote"), F.lit("active").alias("status"),
    )
    return rules, submissions.filter(why.isNotNull()).withColumn("reason", why)


def audit(submissions: DataFrame, rules: DataFrame, published_by: str, now: Column | None = None) -> DataFrame:
    """An audit row a published submission, with what was extracted and what was published as JSON."""
    final = rules.select(F.col("submission_id").alias("_id"), F.col("policy_id").alias("published_policy_id"), F.to_json(F.struct("topic", "subtopic", "condition_text", "action_text", "source_quote")).alias("final_json"))
    joined = submissions.join(final, F.col("id") == F.col("_id"))
    return joined.select(
        key_id("pub", F.lit("admin"), F.col("id")).alias("publish_id"), F.col("id").alias("submission_id"), "published_policy_id", "submitted_by", F.lit(published_by).alias("published_by"), "raw_text",
        F.to_json("item").alias("extracted_json"), "final_json", F.coalesce("source_type", F.lit("admin")).alias("source_type"), F.coalesce("version", F.lit(1)).alias("version"), "replaces_policy_id", "created_at",
        (F.current_timestamp() if now is None else now).alias("published_at"),
    )
