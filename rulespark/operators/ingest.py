"""Registration, deduplication, sectioning, extraction and staging of documents, as one lazy lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions import text as X


def new_id(prefix: str) -> str:
    """A random id, for batches and other things without a natural key."""
    return f"{prefix}_{uuid.uuid4().hex}"


def key_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id: prefix and SHA-256 of the natural key, so that reruns are idempotent."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256).substr(1, 32))


def content(inline: Column, from_file: Column) -> Column:
    """Inline content that is not blank goes before the file's text."""
    return F.coalesce(F.when(F.trim(inline) != "", inline), from_file)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def register(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Documents under (source_uri, content_hash): the last of equal keys in ``new``, with the old id where one exists.

    ``new``: source_uri, raw_content, title, doc_type, batch_id, seq; later ``seq`` wins.
    """
    hashed = new.withColumn("content_hash", F.sha2(F.coalesce("raw_content", F.lit("")), 256)).withColumn("source_uri", F.coalesce("source_uri", F.lit("")))
    one = latest_per_key(hashed, ["source_uri", "content_hash"], [F.desc("seq")]).drop("seq")
    made = one.withColumn("document_id", key_id("doc", F.col("source_uri"), F.col("content_hash")))
    if existing is None:
        return made
    old = existing.select("source_uri", "content_hash", F.col("document_id").alias("_old")).dropDuplicates(["source_uri", "content_hash"])
    return made.join(old, ["source_uri", "content_hash"], "left").withColumn("document_id", F.coalesce("_old", "document_id")).drop("_old")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without a change, and all changes: a rewrite by key, to be written to a new folder."""
    return existing.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def boundaries(rows: DataFrame, key: str, order: str, length: str, total: str) -> DataFrame:
    """The rows with ``start`` and ``next_start``: where each part begins, and where the one after it does or the text ends.

    Parts are one separator apart; places count from 0.
    """
    w = Window.partitionBy(key).orderBy(order)
    start = F.sum(F.col(length) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length) - 1
    return rows.withColumn("start", start).withColumn("next_start", F.coalesce(F.lead("start").over(w), F.col(total) + 1))


def new_only(chunks: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return chunks.join(existing.select(key), key, "left_anti")


def sectioned(documents: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """One row a section: ids, heading, text, ordinal from 1, locator and hash."""
    return (
        documents.select("document_id", "batch_id", F.posexplode(X.sections(F.col("raw_content"), keep_preamble)).alias("pos", "part"))
        .select("document_id", "batch_id", (F.col("pos") + 1).alias("ordinal"), F.col("part.heading").alias("heading"), F.col("part.body").alias("section_text"))
        .withColumn("section_id", key_id("sec", F.col("document_id"), F.col("ordinal")))
        .withColumn("source_locator", F.concat(F.lit("section:"), F.col("ordinal").cast("string")))
        .withColumn("chunk_hash", F.sha2("section_text", 256))
    )


def _mapped(entries: list[tuple[str, Column, str, float, str, Column]]) -> Column:
    """A map of the entries whose test holds; later entries of a name win."""
    item = lambda n, v, t, c, p: F.struct(F.lit(n).alias("key"), F.struct(v.cast("string").alias("value"), F.lit(t).alias("value_type"), F.lit(c).alias("confidence"), F.lit(p).alias("provenance")).alias("value"))
    listed = F.array_compact(F.array(*[F.when(test, item(n, v, t, c, p)) for n, v, t, c, p, test in entries]))
    last = F.filter(listed, lambda e, i: ~F.exists(F.slice(listed, i + 2, F.greatest(F.size(listed), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def extraction_confidence(kind: Column, mapped: Column) -> Column:
    """The base of the chunk type and 0.04 for each mapped field, within 0.05 and 0.95."""
    base = F.create_map(*[F.lit(x) for pair in X.BASE_CONFIDENCE.items() for x in pair])[kind]
    return F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.coalesce(base, F.lit(0.4)) + 0.04 * mapped))


def extracted(sections: DataFrame, canonical: set[str], aliases: dict[str, str], reserved: set[str], version: str = "rules-1", now: Column | None = None) -> DataFrame:
    """Staging rows: candidate struct, mapped fields and unmapped concepts of each section, by rules alone.

    A complete list (a list heading and three items) is kept whole; all else goes through chunk type,
    condition, action and keyword rules. The annual amount keeps its number: the label scan does not
    write over it.
    """
    body = F.col("section_text")
    df = sections.withColumn("_list", X.list_text(body)).withColumn("_items", X.list_items(F.col("_list"))).withColumn("_head", X.list_heading(F.col("_list")))
    df = df.withColumn("_is_list", F.col("_head").isNotNull() & (F.size("_items") >= 3)).withColumn("_norm", X.transcript(body)).withColumn("_low", F.lower("_norm"))
    topic, sub = X.topic_pair(F.col("_norm"))
    kind = F.when(F.col("_is_list"), "policy_list").otherwise(X.chunk_type(body))
    df = df.withColumns({"chunk_type": kind, "_topic": topic, "_sub": sub, "_cond": X.condition(body), "_act": X.action(body), "_instr": F.col("_low").rlike(X.INSTRUCTION), "_amount": X.annual_amount(F.col("_norm"))})
    kept = F.concat(F.col("_head"), F.lit(":\n"), F.array_join(F.transform("_items", lambda i: F.concat(F.lit("- "), i)), "\n"))
    more = F.when(F.size("_items") > 8, F.concat(F.lit(", and "), (F.size("_items") - 8).cast("string"), F.lit(" more"))).otherwise("")
    listing = F.concat(F.col("_head"), F.lit(" list includes: "), F.array_join(F.slice("_items", 1, 8), ", "), more, F.lit("."))
    df = df.withColumn("_rec", F.when(F.col("chunk_type") == "recommendation", X.summary(F.col("_norm"), 280)))
    df = df.withColumn("_do", F.when(F.col("chunk_type").isin("procedure", "recommendation") & F.col("_instr") & F.col("_act").isNull() & F.col("_rec").isNull(), X.summary(F.col("_norm"), 240)))
    plain, yes = ~F.col("_is_list"), F.lit("true")
    said = {raw: plain & F.col("_low").contains(raw.replace("_", " ")) for raw in X.RAW_LABELS}
    target = {raw: aliases.get(raw, raw) for raw in X.RAW_LABELS}
    entries = [
        ("topic", X.list_topic(F.col("_head")), "string", 0.9, "deterministic:list_heading", F.col("_is_list")),
        ("action_text", kept, "string", 0.9, "deterministic:complete_list", F.col("_is_list")),
        ("topic", F.lit("policy"), "string", 0.58, "keyword:policy", plain & F.col("_low").contains("policy")),
        ("topic", F.col("_topic"), "string", 0.68, "semantic:topic", plain & F.col("_topic").isNotNull()),
        ("subtopic", F.col("_sub"), "string", 0.64, "semantic:subtopic", plain & F.col("_sub").isNotNull()),
        ("condition_text", F.col("_cond"), "string", 0.7, "semantic:condition", plain & F.col("_cond").isNotNull()),
        ("action_text", F.col("_act"), "string", 0.72, "semantic:action", plain & F.col("_act").isNotNull()),
        ("action_text", F.col("_rec"), "string", 0.66, "semantic:recommendation", plain & (F.col("_rec") != "")),
        ("action_text", F.col("_do"), "string", 0.63, "semantic:instructional_action", plain & (F.col("_do") != "")),
        ("approval_required", yes, "bool", 0.7, "keyword:approval", plain & F.col("_low").contains("approval")),
        ("is_billable", yes, "bool", 0.65, "keyword:billable", plain & F.col("_low").contains("billable")),
        *[(target[r], yes if "required" in r else F.lit(r), "bool" if "required" in r else "string", 0.55, f"alias:{r}", said[r]) for r in X.RAW_LABELS if target[r] in canonical],
        ("amount_threshold", F.col("_amount"), "numeric", 0.75, "regex:annual_cap", plain & F.col("_amount").isNotNull()),
        ("threshold_unit", F.lit("USD"), "string", 0.7, "default:currency", plain & F.col("_amount").isNotNull()),
    ]
    gap = lambda raw, label: F.struct(raw.alias("raw_label"), label.alias("normalized_label"), F.array(raw).alias("observed_values"), F.lit("new_scalar").alias("suggested_classification"), F.lit(1).alias("frequency_in_batch"))
    scanned = F.array_compact(F.array(*[F.when(said[r], gap(F.lit(r), F.lit(target[r]))) for r in X.RAW_LABELS if target[r] not in canonical], F.lit(None).cast("struct<raw_label:string,normalized_label:string,observed_values:array<string>,suggested_classification:string,frequency_in_batch:int>")))
    known = F.array(*[F.lit(c) for c in sorted(canonical | reserved)])
    alias_map = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    tokens = F.transform(F.filter(X.required_tokens(F.col("_norm")), lambda t: ~F.array_contains(known, t)), lambda t: gap(t, F.coalesce(alias_map[t], t)))
    df = df.withColumn("mapped_fields", _mapped(entries)).withColumn("unmapped_concepts", F.when(plain, F.concat(scanned, tokens)).otherwise(F.slice(scanned, 1, 0)))
    score = F.when(F.col("_is_list"), F.lit(0.9)).otherwise(extraction_confidence(F.col("chunk_type"), F.size("mapped_fields")))
    acted = F.coalesce("_act", "_do")
    shaped = F.coalesce("_topic", "_sub", "_cond", "_act", "_do", "_rec").isNotNull()
    df = df.withColumn("confidence", score)
    ok = F.col("_is_list") | (F.col("chunk_type").isin(*X.PUBLISHABLE_TYPES) & (F.col("confidence") >= 0.5) & shaped) | (F.col("chunk_type").isin("procedure", "recommendation") & F.col("_instr") & (F.col("confidence") >= 0.48))
    why = F.when(ok, F.lit(None).cast("string")).when(~F.col("chunk_type").isin(*X.PUBLISHABLE_TYPES), F.concat(F.lit("chunk_type="), F.col("chunk_type"), F.lit(" is non-publishable"))).when(F.col("confidence") < 0.5, F.concat(F.lit("low confidence ("), F.format_number("confidence", 2), F.lit(")"))).otherwise("insufficient structured signal")
    of_list = lambda whole, rest: F.when(F.col("_is_list"), whole).otherwise(rest)
    quote = F.substring(F.when(F.col("_norm") != "", F.col("_norm")).otherwise(F.trim(body)), 1, 600)
    candidate = F.struct(
        key_id("cand", F.col("section_id")).alias("candidate_id"), "document_id", "section_id", "chunk_type", ok.alias("publishable"),
        of_list(listing, X.summary(body)).alias("summary"), of_list(X.list_topic(F.col("_head")), F.col("_topic")).alias("topic"), of_list(F.lit(None), F.col("_sub")).alias("subtopic"),
        of_list(F.lit(None), F.col("_cond")).alias("condition_text"), of_list(kept, acted).alias("action_text"), of_list(F.lit(None), F.col("_rec")).alias("recommendation_text"),
        X.entities(of_list(F.col("_list"), F.col("_norm"))).alias("entities"), of_list(kept, quote).alias("source_quote"), why.alias("reason_if_not_publishable"),
        of_list(kept, F.substring(F.when(F.col("_norm") != "", F.col("_norm")).otherwise(body), 1, 1200)).alias("rule_text"), F.col("confidence"), F.lit(version).alias("extractor_version"),
    )
    return df.select(key_id("ext", F.col("section_id")).alias("extraction_id"), "batch_id", "document_id", "section_id", candidate.alias("candidate"), "mapped_fields", "unmapped_concepts", "confidence", F.lit("pending").alias("status"), *[(F.current_timestamp() if now is None else now).alias(c) for c in ("created_at", "updated_at")])


def renamed(df: DataFrame, column: str, mapping: DataFrame, old: str = "original", new: str = "canonical") -> tuple[DataFrame, DataFrame]:
    """The table with mapped values replaced at once (no chains), and its changed rows. Identity mappings do nothing."""
    m = mapping.filter(F.col(old) != F.col(new)).select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"])
    joined = df.join(m, F.col(column) == F.col("_old"), "left")
    changed = joined.filter(F.col("_new").isNotNull())
    out = lambda d: d.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    return out(joined), out(changed)
