"""Schema evolution: gaps, proposals, gated additive changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("safe_auto", "approval_required", "disallowed")
PROTECTED = ("status", "policy_id", "section_id")


def gaps(staged: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """(concept, gap_type, reason, frequency, examples) of unmapped concepts, most frequent first.

    ``staged``: extraction_id, unmapped_concepts. Examples are up to two observed values an item,
    taken in order while fewer than three are held, so four at most. Items without values show
    nothing, and every other one shows a value, so the first three of a concept are enough: the rank
    limit drops the rest before they are dealt out.
    """
    item = staged.select("extraction_id", F.posexplode("unmapped_concepts").alias("pos", "u"))
    raw = F.lower(F.trim(F.coalesce(F.nullif("u.normalized_label", F.lit("")), "u.raw_label")))
    named = item.select("extraction_id", "pos", raw.alias("raw"), F.coalesce("u.frequency_in_batch", F.lit(1)).alias("n"), F.slice(F.coalesce("u.observed_values", F.array().cast("array<string>")), 1, 2).alias("seen")).filter("raw <> ''")
    named = named.join(dictionary, named["raw"] == dictionary["alias"], "left").withColumn("concept", F.coalesce("canonical", "raw"))
    counts = named.groupBy("concept").agg(F.sum("n").alias("frequency"), F.first("type_hint", ignorenulls=True).alias("hint"))
    first = named.filter(F.size("seen") > 0).withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy("extraction_id", "pos"))).filter("rank <= 3")
    lists = first.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seen"))), lambda s: s["seen"]).alias("lists"))
    taken = F.aggregate("lists", F.array().cast("array<string>"), lambda have, seen: F.when(F.size(have) < 3, F.concat(have, seen)).otherwise(have))
    shown = lists.select("concept", taken.alias("examples"))
    kind = gap_type(F.col("concept"), F.coalesce("hint", F.lit("text")), columns)
    why = F.when(kind == "new_value", "an existing field has new values").when(kind == "new_relationship", "several values belong in a child table").when(kind == "new_scalar", "a queryable scalar is missing").otherwise("little structure; keep as text")
    return counts.join(shown, "concept", "left").select("concept", kind.alias("gap_type"), why.alias("reason"), "frequency", F.coalesce("examples", F.array().cast("array<string>")).alias("examples")).orderBy(F.desc("frequency"), "concept")


def gap_type(concept: Column, hint: Column, columns: list[str]) -> Column:
    return F.when(concept.isin(columns), "new_value").when(hint == "relationship", "new_relationship").when(hint.isin("numeric", "bool", "enum_like"), "new_scalar").otherwise("text_only")


def migration_class(kind: Column, concept: Column) -> Column:
    return F.when(kind == "new_value", "safe_auto").when(kind.isin("new_scalar", "new_relationship"), "approval_required").when(concept.isin(*PROTECTED), "disallowed").otherwise("approval_required")


def proposals(found: DataFrame, batch_id: str) -> DataFrame:
    """One pending request for each class that has gaps."""
    item = F.struct("concept", "gap_type", "reason", "frequency", "examples")
    grouped = found.withColumn("migration_class", migration_class(F.col("gap_type"), F.col("concept"))).groupBy("migration_class").agg(F.sort_array(F.collect_list(item)).alias("items"))
    key = F.sha2(F.concat_ws("\x1f", F.lit(batch_id), "migration_class", F.array_join(F.transform("items", lambda i: i["concept"]), ",")), 256)
    return grouped.select(F.concat(F.lit("scr_"), F.substring(key, 1, 32)).alias("request_id"), F.lit(batch_id).alias("batch_id"), "migration_class", "items", F.lit("pending").alias("decision_status"))


def may_apply(migration: str, decision: str) -> str | None:
    """Why a request may not be applied, or None."""
    if migration == "disallowed":
        return "disallowed changes are never applied"
    if migration not in CLASSES:
        return f"unknown class {migration}"
    if migration == "approval_required" and decision != "approved":
        return "approval is required"
    if migration == "safe_auto" and decision not in ("approved", "auto_approved", "pending"):
        return f"decision {decision} does not allow it"
    return None


def identifiers(names: list[str]) -> None:
    if bad := [c for c in names if not re.fullmatch(r"[a-z_][a-z0-9_]*", c)]:
        raise ValueError(f"not identifiers: {bad}")


def added(df: DataFrame, concepts: list[str]) -> DataFrame:
    """The table with a null string column for each concept it lacks; concepts must be plain identifiers."""
    identifiers(concepts)
    return df.withColumns({c: F.lit(None).cast("string") for c in dict.fromkeys(concepts) if c not in df.columns})


def child_table(df: DataFrame, key: str, values: str) -> DataFrame:
    """(id, key, value_text): a relationship's values, one row each."""
    rows = df.select(F.col(key).cast("string").alias(key), F.posexplode(values).alias("pos", "value_text")).filter("value_text is not null")
    return rows.select(F.sha2(F.concat_ws("\x1f", key, "pos", "value_text"), 256).alias("id"), key, "value_text")


CHILD = "id string, policy_id string, value_text string, created_at timestamp"


def apply(df: DataFrame, requests: list[dict]) -> tuple[DataFrame, list[str], list[dict]]:
    """(the evolved table, names of child tables to create, a log row for each request).

    Scalars become columns; a relationship becomes a child table ``policy_<concept>`` of ``CHILD``. A
    request is applied as a whole or not at all: one that may not be is logged as skipped, one that
    fails as failed, and both leave the table as it was.
    """
    log, children = [], []
    for r in requests:
        of = lambda kind: [i["concept"] for i in r["items"] if i["gap_type"] == kind]  # noqa: E731, B023
        scalars, relations = of("new_scalar"), of("new_relationship")
        status, error = "applied", may_apply(r["migration_class"], r["decision_status"])
        if error is not None:
            status = "skipped"
        else:
            try:
                identifiers(relations)
                df = added(df, scalars)
                children += [f"policy_{c}" for c in relations if f"policy_{c}" not in children]
            except ValueError as e:
                status, error = "failed", str(e)
        log.append({"request_id": r["request_id"], "status": status, "error_text": error, "columns": scalars if status == "applied" else [], "tables": [f"policy_{c}" for c in relations] if status == "applied" else []})
    return df, children, log
