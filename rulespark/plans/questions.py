"""Retrieval for a table of questions: one plan that finds each question the rows of its first step that has any.

``search.run`` asks one question in up to six jobs. Here specifications are rows. Every step of every
question's ladder is a set of conditions; equal sets of different questions are one. A set reads the rules
under its rarest condition (a key and a value, from counts over the rules) and tests the others on the
row, so one join serves all questions and steps. Each set keeps its first rows only, in shares before the
last sort, and each question takes the least step whose set found something.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions import text as X
from rulespark.operators.keywords import MARK, best_of, holders, marked, postings, words_asked
from rulespark.schema import FILTER_KEYS

from .search import CASELESS, LIST_TEXT, RANK, blob, completeness
from .spec import LIMIT, LIST_LIMIT, SCOPE, SearchSpec, list_terms, relaxations

FILTERS = "map<string,array<string>>"
#: The step of the keyword fallback as it is shown, and in the order of steps.
KEYWORDS, LAST = -1, 1_000_000
#: Keys that a complete list keeps as conditions; the others only give terms.
LIST_SCOPE = ("status", *SCOPE)


def planned(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id, question, intent, filters) by rules, without a model: scope and status, category and activity, as the intent has it.

    A row for each question; null and blank questions have the intent ``fallback``.
    """
    q = F.coalesce(F.col(text_col), F.lit(""))
    kind, batch, document = X.question_class(q), F.regexp_extract(q, r"(?i)\b(bat_[a-z0-9]+)\b", 1), F.regexp_extract(q, r"(?i)\bdocument_id\s*[:=]\s*([a-z0-9_-]+)", 1)
    one = lambda k, v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(k).alias("key"), F.array(v).alias("value")))
    every = F.array_compact(F.array(one("status", F.lit("active")), one("policy_category", kind["policy_category"]), one("activity_type", kind["activity_type"]), one("batch_id", batch), one("document_id", document)))
    # a list keeps scope and status
    kept = F.when(F.col("intent") == "complete_list", F.filter(F.col("every"), lambda e: e["key"].isin(*LIST_SCOPE))).otherwise(F.col("every"))
    return questions.select(F.col(id_col).alias("id"), q.alias("question"), X.intent(q).alias("intent"), every.alias("every")).select("id", "question", "intent", F.map_from_entries(kept).alias("filters"))


LADDER = "id {}, step int, listing boolean, conditions array<struct<key:string,values:array<string>>>, terms array<string>, set string"


def _steps_of(intent: str | None, filters: list[tuple[str, list[str | None] | None]]) -> Iterator[tuple[int, bool, list[dict], list[str], str]]:
    """(step, listing, conditions, terms, set) of one question's ladder; the set is a hash of the three before it."""
    have = SearchSpec({k: [x for x in v or [] if x is not None and x.strip()] for k, v in filters}, intent=intent or "fallback")
    listing = have.intent == "complete_list"
    for n, wider in enumerate([have, *relaxations(have)]):
        # a status that is not named is no list yet
        many = {k: v if isinstance(v, list) else [v] for k, v in wider.filters.items()}
        kept = {k: sorted({x.lower() if k in CASELESS else x for x in v}) for k, v in many.items() if v and (not listing or k in LIST_SCOPE)}
        conditions = [{"key": k, "values": kept[k]} for k in sorted(kept)]
        terms = sorted({t.lower() for t in list_terms(SearchSpec(many))}) if listing else []
        yield n, listing, conditions, terms, hashlib.sha256(json.dumps([listing, conditions, terms]).encode()).hexdigest()


def steps(asked: DataFrame) -> DataFrame:
    """(id, step, listing, conditions, terms, set) of each question's ladder: its own filters, then ``spec.relaxations``.

    Conditions are sorted (key, values), in lower case where case does not count; terms are those of a
    complete list, which keeps the scope only. Steps of one ``set`` find the same rows.
    """

    def run(batches):
        for b in batches:
            ids, intents, filters = (b.column(i).to_pylist() for i in range(3))
            rows = [(i, *s) for i, n, f in zip(ids, intents, filters, strict=True) for s in _steps_of(n, f or [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, [b.schema.field(0).type, pa.int32(), pa.bool_(), _CONDITIONS, pa.list_(pa.string()), pa.string()], strict=True)], names=["id", "step", "listing", "conditions", "terms", "set"])

    return asked.select("id", "intent", "filters").mapInArrow(run, LADDER.format(asked.schema["id"].dataType.simpleString()))


_CONDITIONS = pa.list_(pa.struct([("key", pa.string()), ("values", pa.list_(pa.string()))]))


def _fields(rules: DataFrame) -> DataFrame:
    """The rules with a map of their filter fields, as conditions see them; a field that the table lacks is null."""
    text = lambda k: F.lower(F.col(k).cast("string")) if k in CASELESS else F.col(k).cast("string")
    fields = F.create_map(*[x for k in FILTER_KEYS if k in rules.columns for x in (F.lit(k), text(k))])
    return rules.withColumn("_fields", fields)


def _passes(conditions: Column, fields: Column) -> Column:
    """Whether every condition holds; a rule without a category passes any."""
    value = lambda c: F.try_element_at(fields, c["key"])
    return F.forall(conditions, lambda c: F.coalesce(F.array_contains(c["values"], value(c)), F.lit(False)) | ((c["key"] == "policy_category") & value(c).isNull()))


def _keys_of(conditions: Column) -> Column:
    """The posted (key, value) under which a condition's rules are, those without a category too; all rules for no condition."""
    posts = lambda c: F.concat(F.transform(c["values"], lambda v: F.struct(c["key"].alias("key"), v.alias("value"))), F.when(c["key"] == "policy_category", F.array(F.struct(c["key"].alias("key"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    return F.transform(F.concat(F.array(F.struct(F.lit("").alias("key"), F.array(F.lit("")).alias("values"))), conditions), posts)


def _under_rarest(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set, listing, the rules' columns): the rules that pass each set's conditions. ``sets``: (set, listing, conditions)."""
    entries = F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))), F.map_entries("_fields"))
    named = lambda e: (e["key"].alias("_key"), F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("")).alias("_value"))
    posted = rules.select("*", F.explode(entries).alias("_at")).select(*rules.columns, *named(F.col("_at")))
    asked = sets.select("set", "listing", "conditions", F.posexplode(_keys_of(F.col("conditions"))).alias("nth", "posts"))
    asked = asked.select("set", "listing", "conditions", "nth", F.explode("posts").alias("p")).select("set", "listing", "conditions", "nth", *named(F.col("p")))
    # rules are counted under what is asked for only
    counts = posted.join(asked.select("_key", "_value").distinct(), ["_key", "_value"], "left_semi").groupBy("_key", "_value").agg(F.count("*").alias("_n"))
    one = Window.partitionBy("set")
    sized = asked.join(counts, ["_key", "_value"], "left").withColumn("_n", F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("set", "nth")))
    anchors = sized.withColumn("_first", F.min(F.struct("_n", "nth")).over(one)).filter("nth = _first.nth").select("set", "listing", "conditions", "_key", "_value")
    return posted.join(anchors, ["_key", "_value"]).filter(_passes(F.col("conditions"), F.col("_fields"))).select("set", "listing", *rules.columns)


def _listed(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set, listing, the rules' columns): for each set (set, conditions, terms) the rules in scope that hold a term, or share a document or section with one that does.

    Siblings come from matches anywhere; only the result is held to the scope.
    """
    texts = marked(rules, ["policy_id"], LIST_TEXT)
    wanted = sets.select("set", F.explode("terms").alias("term"))
    held = wanted.join(holders(wanted.select("term"), postings(texts, ["policy_id"]), texts, ["policy_id"], wildcards=True), "term").select("set", F.col("policy_id").alias("_id"), F.col(MARK).alias("_mark")).distinct()
    # a rule is found as itself, by its document or by its section, each time with all its equals
    way = lambda n, v: F.struct(F.lit(n).alias("way"), v.alias("of"))
    ways = F.array(way(0, F.sha2(F.to_json(F.struct(*rules.columns)), 256)), way(1, F.col("document_id")), way(2, F.col("section_id")))
    dealt = rules.withColumn("_ways", ways)
    hits = dealt.withColumn("_own", F.xxhash64(blob(LIST_TEXT)))
    keys = hits.join(held, hits["policy_id"].eqNullSafe(held["_id"]) & (hits["_own"] == held["_mark"])).select("set", F.explode("_ways").alias("w")).select("set", "w.way", "w.of").filter("of is not null").distinct()
    every = dealt.select(F.col("_ways")[0]["of"].alias("_row"), F.struct(*rules.columns).alias("_r"), F.explode("_ways").alias("w")).select("_row", "_r", "w.way", "w.of").join(keys, ["way", "of"])
    copies = every.groupBy("set", "_row").agg(F.first("_r").alias("_r"), F.greatest(*[F.count_if(F.col("way") == i) for i in range(3)]).cast("int").alias("n"))
    kept = copies.join(sets.select("set", "conditions"), "set").filter(_passes(F.col("conditions"), F.col("_r._fields")))
    return kept.select("set", "_r", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(LIST_LIMIT)))).alias("_copy")).select("set", F.lit(True).alias("listing"), "_r.*")


def answers(resolved: DataFrame, asked: DataFrame, keyword_columns: tuple[str, ...] = ("summary", "action_text", "topic", "source_quote"), limit: int = LIMIT, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(id, step, rank, policy_id): the rows that ``search.run`` finds each question of ``asked`` (id, question, intent, filters).

    The step is the number of relaxations it took, -1 for the keyword fallback; a question that finds
    nothing has no row. ``resolved`` has the fields of ``search.resolved_policies``; its columns for
    filters may be missing, and conditions on them then fail. Ids of questions are unique. Ties of equal
    rules are told apart by nothing, so either may come first. The plan reads the rules for what the
    questions need: whether there are lists or questions without a status is looked up first.
    """
    rank = F.col(RANK) if RANK in resolved.columns else completeness(F.col("condition_text"), F.col("action_text"))
    needed = [c for c in dict.fromkeys(("policy_id", "document_id", "section_id", *LIST_TEXT)) if c in resolved.columns]
    rules = _fields(resolved).select(*needed, "_fields", rank.alias("_order"))
    ladder = steps(asked)
    sets = ladder.select("set", "listing", "conditions", "terms").dropDuplicates(["set"])
    by_terms = F.col("listing") & (F.size("terms") > 0)
    no_status = ~F.coalesce(F.map_contains_key("filters", "status"), F.lit(False))
    need_lists = not ladder.filter(by_terms).isEmpty()
    found = _under_rarest(sets.filter(~by_terms).select("set", "listing", "conditions"), rules)
    shown = ["set", "listing", "policy_id", "_order", "topic", "subtopic"]
    found = found.select(*shown)
    if need_lists:
        found = found.union(_listed(sets.filter(by_terms), rules).select(*shown))
    # lists by topic and subtopic, others by completeness
    order = [F.when(F.col("listing"), 0).otherwise(F.col("_order")), *[F.when(F.col("listing"), F.col(c)).asc_nulls_last() for c in ("topic", "subtopic")], F.col("policy_id")]
    best = best_of(found.withColumnRenamed("set", "id"), order, max(limit, list_limit)).filter(F.col("listing") | (F.col("rank") <= limit)).filter(~F.col("listing") | (F.col("rank") <= list_limit))
    every = ladder.select("id", "step", "set").join(best.select(F.col("id").alias("set"), "rank", "policy_id"), "set").select("id", "step", "rank", "policy_id")
    if not asked.filter(no_status).isEmpty():
        # the last step of all. If a question names a status, the step before had the same scope and found
        # nothing there, and no keyword can
        every = every.union(_by_keywords(resolved, asked.filter(no_status), keyword_columns, limit))
    first = every.withColumn("_least", F.min("step").over(Window.partitionBy("id"))).filter("step = _least")
    return first.select("id", F.when(F.col("step") == LAST, KEYWORDS).otherwise(F.col("step")).alias("step"), "rank", "policy_id")


def _by_keywords(resolved: DataFrame, asked: DataFrame, columns: tuple[str, ...], limit: int) -> DataFrame:
    """(id, step, rank, policy_id): rows in each question's scope that hold a keyword of it."""
    scope = steps(asked).filter("step = 0").select("id", F.filter("conditions", lambda c: c["key"].isin(*LIST_SCOPE)).alias("conditions"))
    rows = _fields(resolved).select("policy_id", "_fields", blob(columns).alias("text")).withColumn(MARK, F.xxhash64("text"))
    texts, words = rows.select("policy_id", "text", MARK), words_asked(asked, "id", "question").distinct()
    held = words.join(holders(words, postings(texts, ["policy_id"]), texts, ["policy_id"], wildcards=True), "term").select("id", F.col("policy_id").alias("_id"), F.col(MARK).alias("_mark")).distinct()
    hits = rows.join(held, rows["policy_id"].eqNullSafe(held["_id"]) & (rows[MARK] == held["_mark"])).join(scope, "id").filter(_passes(F.col("conditions"), F.col("_fields")))
    return best_of(hits.select("id", "policy_id"), [F.col("policy_id")], limit).select("id", F.lit(LAST).alias("step"), "rank", "policy_id")
