"""Batch ingestion, schema changes, publication and question answering, end to end over a ``Store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark import schema
from rulespark.operators import admin, evolve, ingest, profile, publish, summaries
from rulespark.plans import models, search, spec
from rulespark.sources.sinks import Store

POLICY_FIELDS = [f for f in schema.FIELDS if f not in ("document_id", "batch_id", "summary")]

#: Tables that exist before anything is ingested.
FOUNDATION = {
    "ingestion_batches": publish.BATCH,
    "schema_change_requests": "request_id string, batch_id string, migration_class string, items array<struct<concept:string,gap_type:string,reason:string,frequency:bigint,examples:array<string>>>, decision_status string, reviewer string, decision_note string, decided_at timestamp, created_at timestamp, updated_at timestamp",
    "schema_migration_log": "migration_id string, request_id string, status string, error_text string, columns array<string>, tables array<string>, applied_by string, applied_at timestamp",
}


def bootstrap(store: Store) -> list[str]:
    """Create the foundation tables that do not exist; running it again changes nothing."""
    return store.create(FOUNDATION)


def create_batch(store: Store, triggered_by: str, trigger_source: str = "manual") -> str:
    bootstrap(store)
    batch_id = ingest.new_id("bat")
    store.append("ingestion_batches", publish.batch_row(store.spark, batch_id, triggered_by, trigger_source))
    return batch_id


def ingest_batch(store: Store, batch_id: str, inputs: DataFrame, extractor: models.Extractor | None = None) -> DataFrame:
    """Register, section, extract and stage a batch. ``inputs``: source_uri, raw_content, title, doc_type, seq[, content].

    Names are those of the dictionary with the store's overrides. An ``extractor`` is asked first where
    the rules see no complete list; where it fails, the rules decide. Rows whose payload breaks its
    contract are staged as failed, with the reason, and are not published.
    Inline ``content`` that is not blank goes before ``raw_content``. All tables change together.
    """
    with store.transaction():
        bootstrap(store)
        if store.read("ingestion_batches").filter(F.col("batch_id") == batch_id).isEmpty():
            store.append("ingestion_batches", publish.batch_row(store.spark, batch_id, "library"))
        if "content" in inputs.columns:
            inputs = inputs.withColumn("raw_content", ingest.content(F.col("content"), F.col("raw_content"))).drop("content")
        docs = ingest.register(inputs.withColumn("batch_id", F.lit(batch_id)), store.read("documents"))
        store.upsert("documents", docs, ["source_uri", "content_hash"])
        docs = store.read("documents").filter(F.col("batch_id") == batch_id)
        store.replace_documents("sections", ingest.sectioned(docs))
        mine_now = store.read("sections").filter(F.col("batch_id") == batch_id)
        staged = ingest.extracted(mine_now, *schema.names_of(store.read("schema_dictionary_overrides")))
        if extractor is not None:
            staged = models.with_model(staged, mine_now, extractor)
        staged = staged.withColumn("publish_error", publish.payload_error()).withColumn("status", F.when(F.col("publish_error").isNotNull(), "failed").otherwise(F.col("status")))
        store.upsert("staging", staged, ["extraction_id"])
        mine = lambda t: store.read(t).filter(F.col("batch_id") == batch_id)
        totals = publish.batch_totals(mine("ingestion_batches"), mine("documents"), mine("sections"), mine("staging"))
        store.upsert("ingestion_batches", totals, ["batch_id"])
    return store.read("staging").filter(F.col("batch_id") == batch_id)


def plan_changes(spark: SparkSession, store: Store, batch_id: str) -> DataFrame:
    """Propose schema changes for what the batch's rows could not be mapped to."""
    bootstrap(store)
    staged = publish.pending(store.read("staging"), batch_id)
    changes = store.read("schema_dictionary_overrides")
    found = evolve.gaps(staged, schema.dictionary(spark, None if changes is None else schema.overridden(changes)), [*POLICY_FIELDS, "policy_id", "section_id"])
    now = F.current_timestamp()
    made = evolve.proposals(found, batch_id).withColumns({c: F.lit(None).cast(t) for c, t in (("reviewer", "string"), ("decision_note", "string"), ("decided_at", "timestamp"))} | {"created_at": now, "updated_at": now})
    store.insert_absent("schema_change_requests", made, "request_id")
    return store.read("schema_change_requests").filter(F.col("batch_id") == batch_id)


def decide(store: Store, request_ids: list[str], decision: str, reviewer: str, note: str = "") -> None:
    """Approve or reject change requests."""
    store.rewrite("schema_change_requests", admin.decided(store.read("schema_change_requests"), request_ids, decision, reviewer, note))


def apply_changes(store: Store, applied_by: str = "library") -> list[dict]:
    """Apply approved and automatic change requests to the rule table, first come first; the log rows that were added."""
    with store.transaction():
        requests = store.read("schema_change_requests").filter(F.col("decision_status").isin("approved", "pending")).orderBy("created_at", "request_id")
        asked = [r.asDict(recursive=True) for r in requests.collect()]  # a request a class and batch
        rules = store.read("policies")
        if rules is None:
            rules = store.spark.createDataFrame([], "policy_id string, extraction_id string, section_id string")
        evolved, children, log = evolve.apply(rules, asked)
        if evolved.columns != rules.columns or store.read("policies") is None:
            store.rewrite("policies", evolved)
            summarize(store)
        store.create({c: evolve.CHILD for c in children})
        done = [x for x in log if x["status"] != "skipped"]
        rows = [(ingest.new_id("mig"), x["request_id"], x["status"], x["error_text"], x["columns"], x["tables"], applied_by) for x in done]
        kind = "migration_id string, request_id string, status string, error_text string, columns array<string>, tables array<string>, applied_by string"
        if rows:
            store.append("schema_migration_log", store.spark.createDataFrame(rows, kind).withColumn("applied_at", F.current_timestamp()))
            # an automatic change counts as decided once it is applied
            applied = [x["request_id"] for x in done if x["status"] == "applied"]
            state = F.when(F.col("request_id").isin(*applied) & (F.col("migration_class") == "safe_auto"), "auto_approved").when(F.col("request_id").isin(*applied), "applied").otherwise(F.col("decision_status"))
            store.rewrite("schema_change_requests", store.read("schema_change_requests").withColumn("decision_status", state))
    return log


def publish_batch(store: Store, batch_id: str | None = None) -> DataFrame:
    """Publish what passes the gate; an extraction is published once however often this runs."""
    with store.transaction():
        bootstrap(store)
        staged = store.read("staging")
        mine = staged if batch_id is None else staged.filter(F.col("batch_id") == batch_id)
        have = store.read("policies")
        fields = [*POLICY_FIELDS, *[c for c in (have.columns if have is not None else []) if c not in (*POLICY_FIELDS, "policy_id", "extraction_id", "section_id", "submission_id")]]
        rules = publish.published(mine, fields)
        if have is not None and "extraction_id" in have.columns:
            rules = ingest.new_only(rules, have, "extraction_id")
        store.append("policies", rules)
        summarize(store)
        extracted = store.read("policies").filter("extraction_id is not null")
        store.insert_absent("audit", publish.audit(extracted), "publish_id")
        store.rewrite("staging", publish.decided(staged, batch_id))
        counters = publish.batch_counters(store.read("staging"))
        closed = counters if batch_id is None else counters.filter(F.col("batch_id") == batch_id)
        store.rewrite("ingestion_batches", publish.batch_completion(store.read("ingestion_batches"), closed))
    return publish.batch_counters(store.read("staging"))


def publish_submissions(store: Store, submissions: DataFrame, published_by: str) -> DataFrame:
    """Publish judged submissions with their audit; the refused ones with the reason."""
    rules, refused = admin.published(submissions)
    with store.transaction():
        have = store.read("policies")
        fresh = rules if have is None else ingest.new_only(rules, have, "policy_id")
        store.append("policies", fresh)
        summarize(store)
        store.insert_absent("admin_audit", admin.audit(submissions, rules, published_by), "publish_id")
    return refused


def typed_rules(store: Store) -> DataFrame:
    """The rule table with booleans and numbers by the type hints, and ``field_errors`` for what they cannot hold."""
    return publish.typed(store.read("policies"))


def resolved(store: Store) -> DataFrame:
    """The rules with their extraction, section and document."""
    return search.resolved_policies(*[store.read(t) for t in ("policies", "audit", "staging", "sections", "documents")])


def ask(store: Store, question: str, raw_spec: dict | None = None, batch_id: str | None = None, document_id: str | None = None, planner: models.Planner | None = None, formatter: models.Formatter | None = None, context: models.Cached | None = None, cache: DataFrame | None = None) -> dict:
    """Answer a question: plan, relax, fall back, format.

    The specification is ``raw_spec``, or the planner's. If the rules cannot be read, the rows of
    ``cache`` that share most words with the question answer it, and ``error`` says why.
    """
    if not (question or "").strip():
        raise ValueError("the question is empty")
    wide = spec.expand(question, whole_words=True)
    told = "" if raw_spec is not None or context is None else context()
    plan = spec.with_intent(spec.validate(raw_spec), spec.intent_of(wide)) if raw_spec is not None else models.planned(question, planner, told)
    scope = spec.scope_of(question) | {k: v for k, v in (("batch_id", batch_id), ("document_id", document_id)) if v}
    plan = spec.replace(plan, filters=plan.filters | scope)
    error = None
    try:
        rows, step = search.run(resolved(store), plan, question)
        found = [r.asDict() for r in profile.json_rows(rows).collect()]  # at most 80 rows
    except Exception as e:  # storage fails in as many ways as there are file systems
        if cache is None:
            raise
        rows, step, error = search.overlap_topk(cache, question, [c for c in search.OFFLINE_TEXT if c in cache.columns], ["policy_id"] if "policy_id" in cache.columns else cache.columns[:1]), -2, str(e)
        found = [r.asDict() for r in profile.json_rows(rows).collect()]  # at most 10 rows
    return {
        "question": question, "answer": models.formatted(question, found, plan.intent, formatter), "rows": found, "rows_found": len(found), "relaxations": step, "intent": plan.intent,
        "spec": {"filters": plan.filters, "fields": list(plan.fields), "comparison": plan.comparison}, "source": "cache" if error else "rules", "error": error,
    }


def _summaries(store: Store) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """(summaries of the rule table's folders that have one, of those that have none yet, all folders)."""
    folders = store.folders("policies")
    have = store.read("_value_summaries")
    kept = None if have is None else have.filter(F.col("part").isin(*folders)) if folders else have.limit(0)
    known = set() if kept is None else {r.part for r in kept.select("part").distinct().collect()}
    new = [f for f in folders if f not in known]
    return kept, summaries.summarized(store.read_folders(new), list(models.CONTEXT_COLUMNS), "_folder") if new else None, folders


def summarize(store: Store) -> int:
    """Summarize the values of the rule table's folders that have no summary yet; the number of rows written.

    A folder's rows never change, so neither does its summary. Once most summaries are of folders that
    the table no longer has, they go.
    """
    kept, made, folders = _summaries(store)
    if made is None:
        return 0
    stale = store.read("_value_summaries").select("part").distinct().count() - kept.select("part").distinct().count() if kept is not None else 0
    return store.append("_value_summaries", made) if stale <= len(folders) else store.rewrite("_value_summaries", kept.unionByName(made))


def value_summary(store: Store, top: int = 10) -> DataFrame | None:
    """The merged summaries of the rule table (``summaries.merged``); only folders without one are read.

    None without a rule table.
    """
    kept, made, _ = _summaries(store)
    found = [s for s in (kept, made) if s is not None]
    return summaries.merged(found[0].unionByName(found[1]) if len(found) > 1 else found[0], top=top) if found else None


def snapshot_context(store: Store, seconds: float = 300.0) -> models.Cached:
    """The planner's context of the rule table, put together again after ``seconds`` from the summaries of its folders; empty if they cannot be read."""

    def make() -> str:
        try:
            whole = value_summary(store)
            total = whole.agg(F.max("n_rows")).first()[0] if whole is not None else 0
            return models.told(total, summaries.values(whole)) if total else models.context(store.read("policies"))
        except Exception:  # as in ``ask``; planning goes on without a context
            return ""

    return models.Cached(make, seconds)
