"""Queries over the driver's tables: every relational operator with the SQL that gives the same rows.

The rule table does not exist there, so orders stand for policies, customers for audits and staging,
events for extraction payloads, and documents and pages for text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions import payload
from rulespark.functions import text as X
from rulespark.operators import admin, evolve, ingest, keywords, names, profile, publish, summaries, vector
from rulespark.plans import questions, search, spec
from rulespark.schema import ALIASES, KEYWORD_STOPS, RESERVED, SYNONYMS, TYPE_HINTS, dictionary
from rulespark.sources import pages

#: Shares of the rows whose quantiles are told.
SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TALK_SQL = "UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations"


def with_talk(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """(id, t): literal texts, and those of all conversations."""
    talk = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("t"))
    return values(spark, rows, "id long, t string").union(talk)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    """The same literal rows for DuckDB."""
    lit = lambda v: "NULL" if v is None else ("true" if v is True else "false" if v is False else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'")
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


# --- retrieval -------------------------------------------------------------------------------

_RESOLVED_SQL = """
SELECT o.o_orderkey AS policy_id, o.o_orderpriority AS topic, coalesce(nullif(o.o_orderstatus, 'O'), c.c_mktsegment) AS action_text,
  c.c_name AS condition_text, c.c_mktsegment AS policy_category, o.o_orderstatus AS status
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0
"""


def resolved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rules; the balance test stays in the join condition, so unmatched orders keep null fields."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.select(F.col("o_orderkey").alias("policy_id"), F.col("o_orderpriority").alias("topic"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), "c_mktsegment").alias("action_text"), F.col("c_name").alias("condition_text"), F.col("c_mktsegment").alias("policy_category"), F.col("o_orderstatus").alias("status"))


_SPEC = spec.SearchSpec({"topic": "1-urgent", "policy_category": "BUILDING", "status": ["O", "F"]}, ("policy_id", "topic", "action_text", "condition_text", "policy_category"))


@query(f"""
SELECT policy_id, topic, action_text, condition_text, policy_category FROM ({_RESOLVED_SQL})
WHERE status IN ('O', 'F') AND lower(topic) = '1-urgent' AND (policy_category = 'BUILDING' OR policy_category IS NULL)
ORDER BY CASE WHEN condition_text IS NOT NULL AND action_text IS NOT NULL THEN 0 WHEN action_text IS NOT NULL THEN 1 WHEN condition_text IS NOT NULL THEN 2 ELSE 3 END, policy_id LIMIT 20
""")
def spec_search_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.standard(resolved_orders(spark, sf_dir), _SPEC)


_RULES_SQL = """
WITH p AS (SELECT o_orderkey AS policy_id, o_custkey::VARCHAR AS section_id, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS topic, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS condition_text, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS action_text FROM orders),
  a AS (SELECT l_orderkey::VARCHAR AS policy_id, 'e' || l_partkey AS extraction_id, CASE l_linestatus WHEN 'O' THEN 'published' ELSE 'failed' END AS publish_status FROM lineitem),
  s AS (SELECT 'e' || p_partkey AS extraction_id, CASE WHEN p_size > 25 THEN 'd' || p_size END AS document_id, p_type AS batch_id, p_name AS summary, p_brand AS topic, p_type AS subtopic FROM part),
  resolved AS (
    SELECT p.policy_id, p.section_id, coalesce(s.document_id, n.n_nationkey::VARCHAR) AS document_id, coalesce(s.batch_id, n.n_name) AS batch_id, coalesce(s.summary, p.condition_text, p.action_text) AS summary,
      coalesce(nullif(p.topic, ''), s.topic) AS topic, s.subtopic AS subtopic, coalesce(nullif(p.condition_text, ''), NULL) AS condition_text, coalesce(nullif(p.action_text, ''), s.topic) AS action_text, s.summary AS source_quote,
      CASE WHEN p.condition_text IS NOT NULL AND p.action_text IS NOT NULL THEN 0 WHEN p.action_text IS NOT NULL THEN 1 WHEN p.condition_text IS NOT NULL THEN 2 ELSE 3 END AS rank
    FROM p LEFT JOIN a ON a.policy_id = p.policy_id::VARCHAR AND a.publish_status = 'published' LEFT JOIN s ON s.extraction_id = a.extraction_id
    LEFT JOIN customer c ON c.c_custkey::VARCHAR = p.section_id LEFT JOIN nation n ON n.n_nationkey::VARCHAR = c.c_nationkey::VARCHAR)
"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rules, line items as audits, parts as staged candidates, customers as sections and nations as documents, resolved."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")
    policies = t("orders").select(F.col("o_orderkey").alias("policy_id"), F.col("o_custkey").alias("section_id"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("topic"), none.alias("subtopic"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("condition_text"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("action_text"), none.alias("source_quote"))
    audits = t("lineitem").select(F.col("l_orderkey").cast("string").alias("policy_id"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("extraction_id"), F.when(F.col("l_linestatus") == "O", "published").otherwise("failed").alias("publish_status"))
    candidate = F.struct(F.col("p_name").alias("summary"), F.col("p_brand").alias("topic"), F.col("p_type").alias("subtopic"), none.alias("condition_text"), F.col("p_brand").alias("action_text"), F.col("p_name").alias("source_quote"))
    staged = t("part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("extraction_id"), F.when(F.col("p_size") > 25, F.concat(F.lit("d"), F.col("p_size").cast("string"))).alias("document_id"), F.col("p_type").alias("batch_id"), candidate.alias("candidate"))
    sections = t("customer").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("document_id"))
    documents = t("nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("batch_id"))
    return search.resolved_policies(policies, audits, staged, sections, documents)


@query(_RULES_SQL + "SELECT policy_id, summary, source_quote FROM resolved")
def left_join_literal_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without a published audit stay, with nothing from staging."""
    return rules(spark, sf_dir).select("policy_id", "summary", "source_quote")


@query(_RULES_SQL + "SELECT policy_id, document_id, batch_id FROM resolved")
def left_join_cast_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir).select("policy_id", "document_id", "batch_id")


@query(_RULES_SQL + "SELECT policy_id, topic, subtopic, condition_text, action_text, summary FROM resolved")
def resolved_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir).select("policy_id", "topic", "subtopic", "condition_text", "action_text", "summary")


@query(_RULES_SQL + "SELECT policy_id, topic, action_text, condition_text, document_id FROM resolved WHERE lower(topic) IN ('1-urgent', 'brand#11') ORDER BY rank, policy_id, document_id LIMIT 20")
def resolved_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spec.SearchSpec({"topic": ["1-URGENT", "Brand#11"]}, ("policy_id", "topic", "action_text", "condition_text", "document_id"))
    found = rules(spark, sf_dir).filter(search.conjunction(wanted.filters)).orderBy(search.RANK, "policy_id", "document_id").limit(search.LIMIT)
    return search.project(found, wanted)


@query("SELECT event_id, event_type, TRY_CAST(props->>'k' AS DOUBLE) AS k, CASE WHEN NOT json_valid(props) THEN 'not JSON' WHEN json_type(props) <> 'OBJECT' THEN 'not an object' END AS payload_error FROM events")
def payload_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property of every event as a number, its payload parsed as VARIANT."""
    return payload.read(table(spark, sf_dir, "events"), "props", {"k": "numeric"}).select("event_id", "event_type", "k", "payload_error")


# orders with a payload of each kind: typed, as text, with texts that are no values, not an object, cut
_PAYLOADS = {
    "1-URGENT": ("{\"approval_required\": true, \"amount_threshold\": ", "}"),
    "2-HIGH": ("{\"approval_required\": \"No\", \"amount_threshold\": \"$1,234,", ".50\"}"),
    "3-MEDIUM": ("{\"approval_required\": \"maybe\", \"amount_threshold\": \"1,", "\"}"),
    "4-NOT SPECIFIED": ("[", "]"),
}
_PAYLOAD_CASES = " ".join(f"WHEN '{k}' THEN '{a}' || (100 + o_orderkey % 900) || '{b}'" for k, (a, b) in _PAYLOADS.items())
_PAYLOAD_TEXT = f"CASE o_orderpriority {_PAYLOAD_CASES} WHEN '5-LOW' THEN '{{\"topic\": ' END"


@query(f"""
WITH t AS (SELECT o_orderkey, {_PAYLOAD_TEXT} AS body FROM orders),
  j AS (SELECT *, json_valid(body) AS ok, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS o FROM t),
  f AS (SELECT *, o->>'approval_required' AS a, o->>'amount_threshold' AS n FROM j),
  v AS (SELECT *, CASE WHEN lower(a) IN ('true', 'yes') THEN true WHEN lower(a) IN ('false', 'no') THEN false END AS b,
    CASE WHEN regexp_full_match(n, '[$]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]+)?') THEN CAST(regexp_replace(n, '[$,]', '', 'g') AS DOUBLE) END AS x FROM f)
SELECT o_orderkey, b::VARCHAR AS approval_required, x AS amount_threshold, CASE WHEN NOT ok THEN 'not JSON' WHEN o IS NULL THEN 'not an object' END AS payload_error,
  concat_ws(',', CASE WHEN a IS NOT NULL AND b IS NULL THEN 'approval_required=' || a END, CASE WHEN n IS NOT NULL AND x IS NULL THEN 'amount_threshold=' || n END) AS field_errors FROM v
""")
def payload_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are typed, told as text, wrong in a field, of another kind and cut, read by the type hints."""
    asked = {n: TYPE_HINTS[n] for n in ("approval_required", "amount_threshold")}
    got = payload.read(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PAYLOAD_TEXT).alias("body")), "body", asked)
    wrong = F.array_join(F.transform("field_errors", lambda e: F.concat(e["field"], F.lit("="), e["value"])), ",")
    return got.select("o_orderkey", F.col("approval_required").cast("string").alias("approval_required"), "amount_threshold", "payload_error", wrong.alias("field_errors"))


@query("SELECT props->>'k' AS k, count(*) AS n FROM events GROUP BY 1")
def json_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_any_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("department", F.col("c_mktsegment"))
    return df.filter(search.predicate("department", ["BUILDING", "MACHINERY"])).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def filter_ci_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("topic", F.col("c_mktsegment"))
    return df.filter(search.predicate("topic", "Building")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'household')")
def filter_ci_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("topic", F.col("c_mktsegment"))
    return df.filter(search.predicate("topic", ["Building", "HouseHold"])).select("c_custkey")


@query(f"SELECT policy_id, policy_category FROM ({_RESOLVED_SQL}) WHERE policy_category IN ('BUILDING', 'MACHINERY') OR policy_category IS NULL")
def filter_null_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_orders(spark, sf_dir).filter(search.predicate("policy_category", ["BUILDING", "MACHINERY"])).select("policy_id", "policy_category")


_LIST_SQL = """
WITH base AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS policy_id, l.l_orderkey::VARCHAR AS document_id, l.l_partkey::VARCHAR AS section_id, p.p_brand AS topic, p.p_type AS subtopic,
    p.p_name AS summary, l.l_returnflag AS status
  FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
), hits AS (
  SELECT * FROM base WHERE lower(coalesce(topic, '')) || ' ' || lower(coalesce(subtopic, '')) || ' ' || lower(coalesce(summary, '')) LIKE '%brand#11%'
)
SELECT policy_id, topic, subtopic, summary FROM base
WHERE status = 'R' AND (policy_id IN (SELECT policy_id FROM hits) OR document_id IN (SELECT document_id FROM hits) OR section_id IN (SELECT section_id FROM hits))
ORDER BY topic NULLS LAST, subtopic NULLS LAST, policy_id LIMIT 80
"""


@query(_LIST_SQL)
def complete_list_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    base = l.join(p, l["l_partkey"] == p["p_partkey"], "left").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("policy_id"), text("l_orderkey").alias("document_id"), text("l_partkey").alias("section_id"), F.col("p_brand").alias("topic"), F.col("p_type").alias("subtopic"), F.col("p_name").alias("summary"), F.col("l_returnflag").alias("status"), none.alias("condition_text"), none.alias("action_text"), none.alias("source_quote"), none.alias("policy_category"))
    return search.complete_list(base, spec.SearchSpec({"status": "R", "topic": "Brand#11"}, ("policy_id", "topic", "subtopic", "summary"), intent="complete_list"))


_QUESTION = "What should the invoice say about the tion reports and where_is data"


@query("""
SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%invoice%' OR lower(text) LIKE '%about%' OR lower(text) LIKE '%tion%' OR lower(text) LIKE '%reports%' OR lower(text) LIKE '%where_is%' OR lower(text) LIKE '%data%' ORDER BY doc_id LIMIT 20
""")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("policy_id", F.col("doc_id"))
    return search.keyword_fallback(docs, spec.SearchSpec({}, ("doc_id", "source")), _QUESTION, columns=("text",))


_TOKENS = ("tion", "their", "with", "from", "ither", "thered")


@query("SELECT doc_id, score FROM (SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in _TOKENS) + " AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def keyword_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.overlap_topk(table(spark, sf_dir, "documents"), " ".join(_TOKENS), ("text",), ["doc_id"]).select("doc_id", "score")


_LADDER = spec.SearchSpec({"activity_type": "none", "policy_category": "BUILDING", "topic": "1-URGENT", "status": "F"}, ("policy_id", "topic", "policy_category"))
_RANK_SQL = "CASE WHEN condition_text IS NOT NULL AND action_text IS NOT NULL THEN 0 WHEN action_text IS NOT NULL THEN 1 WHEN condition_text IS NOT NULL THEN 2 ELSE 3 END"


def _relaxed(step: int) -> Query:
    return lambda spark, sf_dir: search.standard(resolved_orders(spark, sf_dir).withColumn("activity_type", F.lit(None).cast("string")), spec.relaxations(_LADDER)[step])


for _i, _where in enumerate(("lower(topic) = '1-urgent' AND (policy_category = 'BUILDING' OR policy_category IS NULL) AND status = 'F'", "(policy_category = 'BUILDING' OR policy_category IS NULL) AND status = 'F'", "status = 'F'")):
    QUERIES[f"relax_step_{_i + 1}"] = _relaxed(_i)
    ORACLES[f"relax_step_{_i + 1}"] = f"SELECT policy_id, topic, policy_category FROM ({_RESOLVED_SQL}) WHERE {_where} ORDER BY {_RANK_SQL}, policy_id LIMIT 20"


# --- profiles --------------------------------------------------------------------------------

@query("SELECT 'o_orderstatus' AS col, o_orderstatus AS val FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY 2")
def distinct_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.snapshot(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_SUMMARY_SQL = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS val FROM orders" for c in ("o_orderstatus", "o_orderpriority"))


@query(f"""
WITH long AS ({_SUMMARY_SQL}), counts AS (SELECT col, val, count(*) AS n FROM long GROUP BY 1, 2)
SELECT col, sum(n)::BIGINT AS filled, string_agg(val, '|' ORDER BY val) AS first, count(*) AS differing, string_agg(val || '=' || n, '|' ORDER BY n DESC, val) AS frequent FROM counts GROUP BY 1
""")
def value_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a month as a batch: a summary each, merged. With so few values no figure has an error."""
    o = table(spark, sf_dir, "orders")
    parts = summaries.summarized(o, ["o_orderstatus", "o_orderpriority"], F.date_format("o_orderdate", "yyyy-MM"))
    shown = F.array_join(F.transform("frequent", lambda x: F.concat(x["val"], F.lit("="), x["n"])), "|")
    return summaries.merged(parts).select("col", "filled", F.array_join("first", "|").alias("first"), "differing", shown.alias("frequent"))


@query(f"WITH long AS ({_SUMMARY_SQL}) SELECT val, count(*) AS n FROM long WHERE val IN ('1-URGENT', '5-LOW') GROUP BY 1")
def value_counts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.counted(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW", "unknown"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "orders", "documents")))
def table_counts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_counts({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "documents")})


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.breakdown(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY 1")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.breakdown(table(spark, sf_dir, "documents"), "source", non_blank=True)


@query("SELECT o_orderpriority, count(*) AS total, " + ", ".join(f"coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END), 0)::BIGINT AS \"{s}\"" for s in "OFP") + " FROM orders GROUP BY 1")
def batch_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.batch_counters(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ("O", "F", "P"))


@query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 30")
def distinct_ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(30)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("""
SELECT key, rank, value FROM (
  SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY o) AS rank FROM (
    SELECT o_orderstatus AS key, o_orderpriority AS value, o_orderkey AS o, row_number() OVER (PARTITION BY o_orderstatus, lower(o_orderpriority) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1) WHERE rank <= 3
""")
def first_n_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_distinct(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "key"), "key", "o_orderpriority", "o_orderkey", 3)


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderpriority <> '' GROUP BY 1")
def first_non_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_non_blank(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT source, count(*) AS rows, round(avg(length(text)), 4) AS avg_chars, (count(*) FILTER (WHERE regexp_matches(text, '[!?]{2,}')))::BIGINT AS noisy FROM documents GROUP BY 1")
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality(table(spark, sf_dir, "documents"), "source", "text").withColumn("avg_chars", F.round("avg_chars", 4))


@query("SELECT col, array_to_string(list_sort(list(val)), '|') AS vals FROM (SELECT 'o_orderstatus' AS col, o_orderstatus AS val FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY 2) GROUP BY 1")
def value_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = profile.snapshot(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return profile.grouped_values(shown).select("col", F.array_join("values", "|").alias("vals"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def sample_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_rows(table(spark, sf_dir, "customer"), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT event_id, event_type, ts::VARCHAR AS ts FROM events")
def fifo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending rows, first come first; times as DuckDB prints them."""
    staged = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("extraction_id"), F.col("ts").alias("created_at"), F.lit("pending").alias("status"))
    return publish.pending(staged).select(F.col("extraction_id").alias("event_id"), "event_type", F.col("created_at").cast("string").alias("ts"))


@query("SELECT doc_id, left(text, 100) AS text, len(string_split(source, 'r')) AS source FROM documents")
def preview_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("source", "r").alias("source"))
    return profile.preview(docs, "text", "source").withColumn("source", F.col("source").cast("long"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example') AND contains(lower(html), '<p')")
def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.metadata_contains(table(spark, sf_dir, "pages"), {"url": "EXAMPLE", "html": "<p", "page_id": ""}).select("page_id", "url")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2, 3) THEN 'approved' ELSE o_orderstatus END AS decision_status, CASE WHEN o_orderkey IN (1, 2, 3) THEN 'ann' END AS reviewer FROM orders")
def change_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderstatus").alias("decision_status"))
    return admin.decided(requests, ["1", "2", "3"], "approved", "ann").select("o_orderkey", "decision_status", "reviewer")


@query("""
SELECT * FROM (SELECT source, doc_id, row_number() OVER w AS rank, (sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE used <= 12000 AND rank <= 8
""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.context_budget(table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n")), "source", [F.col("doc_id")], F.col("n"), 12000, 8).select("source", "doc_id", "rank", "used")


_EVAL_SQL = """
SELECT item_id, accuracy, completeness, grounding, accuracy + completeness + grounding AS total FROM (
  SELECT item_id, CASE WHEN m1 AND m2 THEN 2 WHEN NOT m1 AND NOT m2 THEN 0 ELSE 1 END AS accuracy, least(2, n1::INT + n2::INT) AS completeness,
    CASE WHEN regexp_matches(text, '\\b\\d{3,4}(?:\\.\\d+)+\\b') THEN 2 WHEN regexp_matches(text, '(?i)\\b(IBC|Table)\\b') THEN 1 ELSE 0 END AS grounding
  FROM (SELECT item_id, text, contains(lower(text), 'the') AS m1, contains(lower(text), 'of') AS m2, contains(lower(text), 'an') AS n1, contains(lower(text), 'que') AS n2 FROM benchmark))
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lits = lambda *w: F.array(*[F.lit(x) for x in w])
    s = profile.eval_scores(F.col("text"), lits("the", "Of"), lits("an", "QUE"))
    return table(spark, sf_dir, "benchmark").select("item_id", *[s[c].alias(c) for c in ("accuracy", "completeness", "grounding", "total")])


@query(_EVAL_SQL)
def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(f"SELECT round(avg(total), 6) AS avg_total, round(avg(CASE WHEN total >= 4 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM ({_EVAL_SQL})")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.eval_aggregate(_scored(spark, sf_dir), 4).select(F.round("avg_total", 6).alias("avg_total"), F.round("pass_rate", 6).alias("pass_rate"))


# --- ingestion -------------------------------------------------------------------------------

@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def latest_per_key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT source AS source_uri, sha256(text) AS content_hash, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def document_upsert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").select(F.col("source").alias("source_uri"), F.col("text").alias("raw_content"), "doc_id", F.col("doc_id").alias("seq"))
    return ingest.register(new).select("source_uri", "content_hash", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_only(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, ordinal, 'Section ' || ordinal AS heading, sha256(ps[ordinal]) AS chunk_hash FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS ordinal FROM parts)
""")
def section_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a paragraph."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("b").alias("batch_id"), F.regexp_replace("text", r"\n", "\n\n").alias("raw_content"))
    return ingest.sectioned(docs).select(F.col("document_id").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "heading", "chunk_hash")


@query("""
WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '^#+', '', 'g')) AS body FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, role || ' ' || turn AS heading, sha256(body) AS chunk_hash FROM t WHERE body <> ''
""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns stand under headings; turns are one line each."""
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.trim(F.regexp_replace("text", r"^#+", "")))
    talks = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", turn.alias("part")).alias("s")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["part"]), "\n").alias("raw_content"))
    docs = talks.select(F.col("conv_id").alias("document_id"), F.lit("b").alias("batch_id"), "raw_content")
    return ingest.sectioned(docs).select(F.col("document_id").alias("conv_id"), F.col("ordinal").cast("long").alias("ordinal"), "heading", "chunk_hash")


@query("""
SELECT doc_id, ordinal, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY ordinal), total + 1) AS next_start FROM (
  SELECT doc_id, ordinal, total, (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) - n - 1)::BIGINT AS start FROM (
    SELECT doc_id, length(text) AS total, length(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents))
""")
def section_boundaries_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("total"), F.posexplode(F.transform(F.split("text", "\n"), F.length)).alias("pos", "n"))
    return ingest.boundaries(rows, "doc_id", "pos", "n", "total").select("doc_id", (F.col("pos") + 1).cast("long").alias("ordinal"), "start", "next_start")


@query()
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.char_chunks(F.col("text"), 400)).alias("chunk_id", "chunk"))


@query("""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')
SELECT doc_id, i // 420 AS pos, array_to_string(ws[i + 1:i + 500], ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 420)) AS i FROM w)
""")
def word_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.word_chunks(F.col("text"), 500, 80)).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query("""
SELECT doc_id, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped FROM (
  SELECT doc_id, NOT (line = '' OR regexp_matches(line, '(?i)^page\\s+\\d+\\s*(\\|\\s*\\d+)?$') OR regexp_matches(line, '^[\\d\\s|/:.-]+$') OR len(string_split(line, ' ')) < 4) AS keep
  FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM documents)) GROUP BY 1
""")
def noise_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.quiet_lines(F.col("text")).alias("q"), F.size(F.split("text", "\n")).alias("n"))
    kept = F.when(F.col("q") == "", 0).otherwise(F.size(F.split("q", "\n"))).cast("long")
    return d.select("doc_id", kept.alias("kept"), (F.col("n") - kept).alias("dropped"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat FROM documents")
def whitespace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapse(F.col("text"))).alias("flat"))


@query("""
WITH n AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,2})\\b', 1), lambda x: NOT (string_split_regex(x, '\\s+')[1] IN ('So', 'All', 'That', 'This', 'And', 'But', 'If', 'Then', 'OK', 'Yep', 'Yeah', 'Thanks', 'Thank'))) AS names FROM (SELECT doc_id, regexp_replace(text, '[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '_', 'g') AS text FROM documents)),
  e AS (SELECT doc_id, list_concat(names, list_filter(['Bitwarden', 'Microsoft Edge', 'OneLogin', 'MFA', 'CSV'], lambda p: regexp_matches(text, '\\b' || p || '\\b'))) AS l FROM n),
  u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM e)
SELECT doc_id, array_to_string(d[1:6], '|') AS entities FROM u WHERE len(d) > 0
""")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words end where letters of any language do; DuckDB's know ASCII only, so it sees the others as underscores."""
    return table(spark, sf_dir, "documents").select("doc_id", X.entities(F.col("text")).alias("e")).filter("size(e) > 0").select("doc_id", F.array_join("e", "|").alias("entities"))


_QUESTIONS = [(1, "Do I need approval for travel?"), (2, "Which activity do I select in my timesheet?"), (3, "Which category is a client dinner"), (4, "What are all the holidays"), (5, "How do I submit a claim?"), (6, "What is a retainer"), (7, "Can I bring a guest"), (8, "hello"), (9, ""), (10, "How do I charge a meal"), (11, "What are the options")]
_CHUNKS = [(1, "If the amount is high, you must call finance"), (2, "Thanks all, bye"), (3, "First open the portal and click save"), (4, "We recommend strong passwords"), (5, "Overtime means hours past forty in a week"), (6, "Lisa 14:28"), (7, "How is it filed?"), (8, ""), (9, "The owner will follow up on this item next week"), (10, "The lake is calm"), (11, "Bob started transcription")]


_INTENT_CASE = """CASE WHEN contains(q, 'approval') THEN 'approval_requirement' WHEN contains(q, 'timesheet') AND (contains(q, 'activity') OR contains(q, 'select')) THEN 'timesheet_activity'
 WHEN contains(q, 'category') OR contains(q, 'categorize') OR (contains(q, 'how do i charge') AND regexp_matches(q, 'dinner|meal|expense|travel')) THEN 'expense_category'
 WHEN contains(q, 'what are') AND (contains(p, ' all ') OR regexp_matches(q, 'holidays|categories|activity codes|activities|options')) THEN 'complete_list'
 WHEN contains(q, 'how do i') OR contains(q, 'steps') OR contains(q, 'submit') THEN 'procedure_steps' WHEN contains(q, 'what is') OR contains(q, 'define') THEN 'definition'
 WHEN contains(q, 'can i') OR contains(q, 'allowed') THEN 'eligibility' ELSE 'fallback' END"""
_CLASS_CASES = """CASE WHEN contains(q, 'marketing') THEN 'marketing' WHEN contains(q, 'bill') OR contains(q, 'charge') THEN 'billing' WHEN contains(q, 'payday') OR contains(q, 'payroll') THEN 'payroll'
  WHEN contains(q, 'overtime') THEN 'overtime' WHEN contains(q, 'travel') OR contains(q, 'expense') THEN 'travel' ELSE 'billing' END AS policy_category,
  CASE WHEN contains(q, 'internal marketing') THEN 'internal marketing' WHEN contains(q, 'campaign') THEN 'client campaign' WHEN contains(q, 'weekend') THEN 'weekend overtime' END AS activity_type"""


@query(f"""
SELECT id, {_INTENT_CASE} AS intent
FROM (SELECT id, ' ' || lower(trim(t)) || ' ' AS p, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS q FROM (
  SELECT id::BIGINT AS id, t FROM {sql_values(_QUESTIONS, "id, t")} {_TALK_SQL}))
""")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_talk(spark, sf_dir, _QUESTIONS).select("id", X.intent(F.col("t")).alias("intent"))


@query(f"""
SELECT id, {_CLASS_CASES}
FROM (SELECT id, lower(t) AS q FROM (SELECT id::BIGINT AS id, t FROM {sql_values(_QUESTIONS, "id, t")} {_TALK_SQL}))
""")
def question_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_talk(spark, sf_dir, _QUESTIONS).select("id", X.question_class(F.col("t")).alias("c")).select("id", "c.policy_category", "c.activity_type")


# --- tables of questions ---------------------------------------------------------------------

_LEADS = ("What are all the holidays? ", "internal marketing and ", "Can I bill document_id: d3 for it? ", "payroll ", "weekend overtime travel ", "")
_CATEGORIES = ("marketing", "billing", "payroll", None, "overtime")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as questions, most behind a lead that gives them a category, an activity, a scope or a list."""
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), ((F.col("conv_id") + F.col("turn")) % len(_LEADS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(lead, "text").alias("question"))


_ASKED_SQL = f"SELECT conv_id * 1000 + turn AS id, {sql_values([tuple(_LEADS)], 'a, b, c, d, e, f').replace('(VALUES', '(SELECT [a, b, c, d, e, f] FROM (VALUES', 1)})[(conv_id + turn) % {len(_LEADS)} + 1] || text AS t FROM conversations"


@query(f"""
WITH asked AS ({_ASKED_SQL}),
  kinds AS (SELECT id, {_INTENT_CASE} AS intent, {_CLASS_CASES}, nullif(regexp_extract(t, '(?i)\\bdocument_id\\s*[:=]\\s*([a-z0-9_-]+)', 1), '') AS doc
    FROM (SELECT id, t, ' ' || lower(trim(t)) || ' ' AS p, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS q FROM asked)),
  ladder AS (
    SELECT id, 0 AS step, intent = 'complete_list' AS listing, CASE WHEN intent <> 'complete_list' THEN policy_category END AS cat, CASE WHEN intent <> 'complete_list' THEN activity_type END AS act, doc FROM kinds
    UNION ALL SELECT id, 1, false, policy_category, NULL, doc FROM kinds WHERE intent <> 'complete_list' AND activity_type IS NOT NULL
    UNION ALL SELECT id, CASE WHEN activity_type IS NULL THEN 1 ELSE 2 END, false, NULL, NULL, doc FROM kinds WHERE intent <> 'complete_list'),
  rules AS (
    SELECT o_orderkey AS policy_id, 'd' || (o_custkey % 10) AS document_id, c_mktsegment AS topic, o_orderpriority AS subtopic, CASE WHEN o_orderstatus = 'P' THEN 'old' ELSE 'active' END AS status,
      CASE left(o_orderpriority, 1) WHEN '1' THEN 'marketing' WHEN '2' THEN 'billing' WHEN '3' THEN 'payroll' WHEN '5' THEN 'overtime' END AS cat, CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 = 0 THEN 'internal marketing' END AS act,
      CASE WHEN c_acctbal > 0 THEN 1 ELSE 3 END - CASE WHEN c_acctbal > 0 AND o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rank
    FROM orders JOIN customer ON c_custkey = o_custkey),
  found AS (
    SELECT l.id, l.step, l.listing, r.policy_id, row_number() OVER (PARTITION BY l.id, l.step ORDER BY CASE WHEN l.listing THEN 0 ELSE r.rank END, CASE WHEN l.listing THEN r.topic END, CASE WHEN l.listing THEN r.subtopic END, r.policy_id) AS rank
    FROM ladder l JOIN rules r ON r.status = 'active' AND (l.cat IS NULL OR r.cat = l.cat OR r.cat IS NULL) AND (l.act IS NULL OR r.act = l.act) AND (l.doc IS NULL OR r.document_id = l.doc))
SELECT id, step, rank::INT AS rank, policy_id FROM (SELECT *, min(step) OVER (PARTITION BY id) AS least FROM found WHERE rank <= CASE WHEN listing THEN 80 ELSE 20 END) WHERE step = least
""")
def ladder_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a question to the orders as rules: planned by rules, relaxed until it finds something, in one plan."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    state, category = F.col("o_orderstatus"), F.element_at(F.array(*[F.lit(x) for x in _CATEGORIES]), F.left("o_orderpriority", F.lit(1)).cast("int"))
    none = F.lit(None).cast("string")
    rules = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("policy_id"), F.concat(F.lit("d"), (F.col("o_custkey") % 10).cast("string")).alias("document_id"), F.col("o_custkey").cast("string").alias("section_id"), F.col("c_mktsegment").alias("topic"), F.col("o_orderpriority").alias("subtopic"),
        F.when(state == "P", "old").otherwise("active").alias("status"), category.alias("policy_category"), F.when((state == "F") & (F.col("o_custkey") % 5 == 0), "internal marketing").alias("activity_type"),
        F.when(state == "F", "x").alias("condition_text"), F.when(F.col("c_acctbal") > 0, "x").alias("action_text"), none.alias("summary"), none.alias("source_quote"),
    )
    return questions.answers(rules, questions.planned(_asked(spark, sf_dir)))


@query(f"""
WITH words AS (
  SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(t), '[a-z0-9_]+'), lambda w: length(w) >= 4 AND NOT list_contains({sorted(KEYWORD_STOPS)}, w))[1:6]) AS w FROM ({_ASKED_SQL})),
  held AS (SELECT w, doc_id FROM (SELECT DISTINCT w FROM words) JOIN documents ON lower(text) LIKE '%' || w || '%'),
  hits AS (SELECT DISTINCT id, doc_id FROM words JOIN held USING (w))
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY doc_id))::INT AS rank, doc_id FROM hits QUALIFY rank <= 20
""")
def keyword_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn the first twenty documents that hold one of its keywords."""
    return keywords.fallback(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "doc_id", ["text"], "question_id", "question")


@query("""
WITH tokens AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 4)) AS t FROM benchmark) GROUP BY 1, 2),
  held AS (SELECT t, doc_id FROM (SELECT DISTINCT t FROM tokens) JOIN documents ON contains(lower(text), t))
SELECT item_id AS id, (row_number() OVER (PARTITION BY item_id ORDER BY sum(n) DESC, doc_id))::INT AS rank, doc_id, sum(n)::BIGINT AS score FROM tokens JOIN held USING (t) GROUP BY item_id, doc_id QUALIFY rank <= 10
""")
def keyword_overlap_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item as a question the ten documents that hold most of its tokens."""
    return keywords.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", ["text"], "item_id", "text")


_CHUNK_SQL = f"""
SELECT id, CASE WHEN low = '' THEN 'filler' WHEN contains(low, 'started transcription') OR contains(low, 'stopped transcription') OR regexp_matches(low, '^[a-z]+\\s+\\d{{1,2}}:\\d{{2}}$') THEN 'transcript_metadata'
 WHEN regexp_matches(low, '\\b(thank you|thanks|bye|hmm|okay|ok)\\b') AND len(string_split(trim(regexp_replace(low, '\\s+', ' ', 'g')), ' ')) <= 12 THEN 'filler' WHEN regexp_matches(low, '\\b(action item|follow up|owner|todo)\\b') THEN 'action_item'
 WHEN regexp_matches(low, '\\b(recommend|suggest|best practice)\\b') THEN 'recommendation' WHEN regexp_matches(low, '\\b(defined as|definition|means)\\b') THEN 'definition'
 WHEN regexp_matches(low, '\\b(if|when)\\b') AND regexp_matches(low, '\\b(should|must|required|need to|cannot|can''t)\\b') THEN 'policy_rule'
 WHEN regexp_matches(low, '\\b(first|next|then|go to|click|set up|enable|open)\\b') THEN 'procedure' WHEN contains(low, '?') AND regexp_matches(low, '\\b(how|what|why|where|when)\\b') THEN 'faq' ELSE 'discussion' END AS chunk_type
FROM (SELECT id, lower(trim(t)) AS low FROM (SELECT id::BIGINT AS id, t FROM {sql_values(_CHUNKS, "id, t")} {_TALK_SQL}))
"""


@query(_CHUNK_SQL)
def chunk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_talk(spark, sf_dir, _CHUNKS).select("id", X.chunk_type(F.col("t")).alias("chunk_type"))


@query(f"""
SELECT id, nullif(upper(left(c, 1)) || lower(substr(c, 2)) || trim(regexp_extract(t, '(?i)\\b(if|when)\\b(.+?)(,|;)', 2)), '') AS condition_text,
  nullif(upper(left(a, 1)) || lower(substr(a, 2)) || trim(regexp_extract(t, '(?i)\\b(should|must|required|need to|cannot|can''t|recommend(?:ed)?)\\b(.+?)(;|$)', 2)), '') AS action_text
FROM (SELECT id, t, regexp_extract(t, '(?i)\\b(if|when)\\b(.+?)(,|;)', 1) AS c, regexp_extract(t, '(?i)\\b(should|must|required|need to|cannot|can''t|recommend(?:ed)?)\\b(.+?)(;|$)', 1) AS a
  FROM (SELECT id, regexp_replace(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^[A-Z][a-z]+(\\s+[A-Z][a-z]+){{0,2}}\\s+\\d{{1,2}}:\\d{{2}}$') AND NOT lower(x) IN ('ok', 'okay', 'yeah', 'yep', 'hmm', 'bye', 'thanks', 'thank you')), ' '), '\\s+', ' ', 'g')), '(?i)^(so|well|okay|ok|alright|all right)[,\\s]+', '') AS t
    FROM (SELECT id::BIGINT AS id, t FROM {sql_values(_CHUNKS, "id, t")} {_TALK_SQL})))
""")
def condition_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_talk(spark, sf_dir, _CHUNKS).select("id", X.condition(F.col("t")).alias("condition_text"), X.action(F.col("t")).alias("action_text"))


@query("""
SELECT page_id, len(items)::INT AS n_items, array_to_string(items[1:3], ', ') AS first_items FROM (
  SELECT page_id, list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))) AS items FROM pages)
""")
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return table(spark, sf_dir, "pages").select("page_id", items.alias("items")).select("page_id", F.size("items").alias("n_items"), F.array_join(F.slice("items", 1, 3), ", ").alias("first_items"))


_LISTS = [(1, "Company holidays:\n- New Year\n- May Day\n- Harvest Day\n- Founders Day"), (2, "Approved tools\n1. Editor\n2) Compiler\na. Linter"), (3, "A plain note"), (4, "Leave categories: sick leave"), (5, "holiday one e holiday two e labor day e may day"), (6, None)]


_ITEM_SQL = "'^([-*•]|\\d+[.)]|[A-Za-z][.)])\\s+(.+)$'"


@query(f"""
WITH a AS (SELECT id, regexp_replace(coalesce(t, ''), '[•◦▪▫]\\s*', chr(10) || '- ', 'g') AS t FROM (SELECT id::BIGINT AS id, t FROM {sql_values(_LISTS, "id, t")} {_TALK_SQL})),
  b AS (SELECT id, t, list_filter(list_transform(string_split_regex(t, '\\s+e\\s+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS parts, len(regexp_extract_all(t, '\\s+e\\s+')) AS seps FROM a),
  c AS (SELECT id, CASE WHEN seps >= 2 AND len(list_filter(parts, lambda p: regexp_matches(p, '(?i)\\b(day|holiday|category|activity|requirement|tool|approval|time)\\b'))) >= 3 THEN array_to_string(parts, chr(10) || '- ') ELSE t END AS t FROM b),
  d AS (SELECT id, regexp_replace(t, '(?im)^([^:\\n]*(?:holidays?|categor(?:y|ies)|tools?|requirements?|activities|activity codes?)[^:\\n]*):[ \\t]+([^-*\\n].+)$', '\\1:' || chr(10) || '- \\2', 'g') AS t FROM c),
  e AS (SELECT id, list_transform(string_split(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls FROM d),
  f AS (SELECT id, list_filter(ls, lambda x: x <> '') AS rows, list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, {_ITEM_SQL})), lambda x: regexp_replace(regexp_replace(regexp_extract(x, {_ITEM_SQL}, 2), '^[ ;,]+|[ ;,]+$', '', 'g'), '\\s+', ' ', 'g')), lambda x: x <> '') AS items FROM e),
  g AS (SELECT id, list_filter(items, lambda x, i: list_position(items, x) = i) AS items, list_filter(rows, lambda x, i: regexp_matches(x, '(?i)(holidays?|categor(y|ies)|tools?|requirements?|activities|activity codes?)') AND (contains(x, ':') OR regexp_matches(coalesce(rows[i + 1], ''), '^([-*•]|\\d+[.)]|[A-Za-z][.)])\\s+')))[1] AS head FROM f)
SELECT id, CASE WHEN contains(head, ':') THEN trim(string_split(head, ':')[1]) ELSE trim(head) END AS heading, array_to_string(items, '|') AS items FROM g
""")
def list_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.list_text(F.col("t"))
    return with_talk(spark, sf_dir, _LISTS).select("id", X.list_heading(t).alias("heading"), F.array_join(X.list_items(t), "|").alias("items"))


@query()
def list_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the lists of all conversations and of the literal ones; title case differs between engines."""
    return with_talk(spark, sf_dir, _LISTS).select("id", X.list_topic(X.list_heading(X.list_text(F.col("t")))).alias("topic")).filter("topic is not null")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand verbatim in documents."""
    return keywords.contains_join(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""
SELECT id, round(least(0.95, greatest(0.05, CASE chunk_type WHEN 'policy_rule' THEN 0.72 WHEN 'procedure' THEN 0.68 WHEN 'recommendation' THEN 0.66 WHEN 'action_item' THEN 0.64 WHEN 'definition' THEN 0.62 WHEN 'faq' THEN 0.58
  WHEN 'discussion' THEN 0.45 WHEN 'transcript_metadata' THEN 0.35 WHEN 'filler' THEN 0.2 ELSE 0.4 END + 0.04 * (id % 20))), 6) AS confidence FROM ({_CHUNK_SQL})
""")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_talk(spark, sf_dir, _CHUNKS)
    return rows.select("id", F.round(ingest.extraction_confidence(X.chunk_type(F.col("t")), F.col("id") % 20), 6).alias("confidence"))


@query()
def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns through the whole rule extraction; its parts have SQL of their own above."""
    turns = with_talk(spark, sf_dir, [*_CHUNKS, *[(100 + i, t) for i, t in _LISTS]])
    sections = turns.select(F.col("id").cast("string").alias("section_id"), F.lit("d").alias("document_id"), F.lit("b").alias("batch_id"), F.coalesce("t", F.lit("")).alias("section_text"))
    staged = ingest.extracted(sections, set(TYPE_HINTS), ALIASES, RESERVED)
    return staged.select("section_id", "candidate.chunk_type", "candidate.publishable", F.round("confidence", 6).alias("confidence"), F.size("mapped_fields").alias("mapped"), F.size("unmapped_concepts").alias("unmapped"))


@query("""
SELECT conv_id, turn, round((CASE WHEN role <> '' THEN 1 ELSE 0 END + CASE WHEN length(text) > 100 THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'approval') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) / 5, 6) AS confidence FROM conversations
""")
def admin_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.when(F.length("text") > 100, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(publish.admin_confidence(F.col("role"), long, F.lit(None).cast("string"), F.col("text")), 6).alias("confidence"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'invalid candidate contract: publishable is missing' WHEN d.doc_id % 10 = 3 THEN 'invalid payload contract: a mapped field has no name'
  WHEN d.n_chars > 4000 THEN 'invalid payload contract: a mapped field''s confidence is outside 0 to 1' WHEN d.doc_id % 10 = 7 THEN 'invalid payload contract: an unmapped concept''s frequency is under 1' WHEN l.quality = 0 THEN 'chunk flagged non-publishable'
  WHEN d.n_chars / 4000 < 0.5 THEN 'confidence below threshold (' || printf('%.2f', least(1.0, d.n_chars / 4000)) || ')' WHEN l.toxic = 1 THEN 'missing meaningful structured fields' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as staged rows, held against the contracts of candidate and payload and the other tests of the gate."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    topic = F.when(F.coalesce("toxic", F.lit(0)) == 0, "x")
    c = F.struct(F.col("doc_id").cast("string").alias("candidate_id"), (F.col("quality") == 1).alias("publishable"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("confidence"), topic.alias("topic"), none.alias("subtopic"), none.alias("condition_text"), none.alias("action_text"), none.alias("recommendation_text"), none.alias("summary"), none.alias("reason_if_not_publishable"))
    mapped = F.create_map(F.when(F.col("doc_id") % 10 == 3, " ").otherwise("topic"), F.struct(F.lit("x").alias("value"), (F.col("n_chars") / 4000).alias("confidence")))
    unmapped = F.array(F.struct(F.lit("cap").alias("raw_label"), F.when(F.col("doc_id") % 10 == 7, 0).otherwise(1).alias("frequency_in_batch")))
    staged = d.select("doc_id", c.alias("candidate"), F.lit(0.0).alias("confidence"), mapped.alias("mapped_fields"), unmapped.alias("unmapped_concepts"))
    return staged.select("doc_id", publish.skip_reason(payload=publish.has_payload(staged)).alias("reason"))


_RENAMES = [("BUILDING", "construction"), ("construction", "never"), ("MACHINERY", "MACHINERY")]


@query(f"SELECT c_custkey, coalesce(v.new, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM {sql_values(_RENAMES, 'old, new')} WHERE old <> new) v ON v.old = c_mktsegment")
def topic_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.renamed(table(spark, sf_dir, "customer"), "c_mktsegment", values(spark, _RENAMES, "original string, canonical string"))[0].select("c_custkey", "c_mktsegment")


@query("""
SELECT coalesce(p.page_id, d.doc_id + 100) AS page, coalesce(url, '') AS text, coalesce(source, '') AS ocr_text,
  CASE WHEN coalesce(url, '') = '' THEN coalesce(source, '') WHEN coalesce(source, '') = '' OR url = source THEN url ELSE url || chr(10) || chr(10) || '[OCR Merge]' || chr(10) || source END AS merged
FROM pages p FULL OUTER JOIN documents d ON p.page_id = d.doc_id + 100
""")
def page_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit("file").alias("source")
    texts = table(spark, sf_dir, "pages").select(one, F.col("page_id").alias("page"), F.col("url").alias("text"))
    ocr = table(spark, sf_dir, "documents").select(one, (F.col("doc_id") + 100).alias("page"), F.col("source").alias("ocr_text"))
    return pages.merged_pages(texts, ocr).select("page", "text", "ocr_text", "merged")


@query("""
SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id, pos)) - 1 AS chunk_id, len(string_split(chunk, ' '))::BIGINT AS tokens FROM (
  SELECT source, doc_id, i AS pos, ws[i + 1] AS chunk FROM (SELECT source, doc_id, ws, unnest(range(0, len(ws))) AS i FROM (
    SELECT source, doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents)))
""")
def global_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, in chunks of one word, numbered through the source."""
    paged = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.col("text").alias("merged"))
    chunks = pages.page_chunks(paged, size=1)
    return chunks.select("source", F.col("page").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("tokens").cast("long").alias("tokens"))


@query("""
SELECT doc_id, len(solid)::INT AS solid, len(list_filter(solid, lambda x: contains(merged, x)))::INT AS covered FROM (
  SELECT doc_id, list_filter(lines, lambda x: length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) >= 2) AS solid,
    trim(regexp_replace(array_to_string(list_filter(lines, lambda x: NOT (x = '' OR regexp_matches(x, '(?i)^page\\s+\\d+\\s*(\\|\\s*\\d+)?$') OR regexp_matches(x, '^[\\d\\s|/:.-]+$') OR len(string_split(x, ' ')) < 4)), ' '), '\\s+', ' ', 'g')) AS merged
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS lines FROM documents))
""")
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid lines of each text, and how many its whole text holds after the noise lines went."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.quiet_lines(F.col("text")).alias("merged"))
    return d.select("doc_id", X.line_cover(F.col("text"), F.col("merged")).alias("c")).select("doc_id", "c.solid", (F.col("c.solid") - F.size("c.lost")).alias("covered"))


_OCR = [(1, "alpha line\nbeta line", "alpha line\nnew line"), (2, "", "only ocr"), (3, "only page", None), (4, "same", "same"), (5, "a b", "\nc d\n\n a b \ne")]


@query(f"""
WITH r AS (SELECT page::BIGINT AS page, trim(coalesce(t, ''), chr(10) || ' ') AS p, trim(coalesce(o, ''), chr(10) || ' ') AS o FROM (
    SELECT page, t, o FROM {sql_values(_OCR, "page, t, o")} UNION ALL SELECT 1000 + doc_id, string_split(text, chr(10))[1], text FROM documents)),
  l AS (SELECT page, p, o, list_transform(string_split(o, chr(10)), lambda x: rtrim(x)) AS ol, list_transform(string_split(p, chr(10)), lambda x: trim(x)) AS pl FROM r),
  m AS (SELECT page, p, array_to_string(ol, chr(10)) AS o, list_filter(ol, lambda x: x = '' OR NOT list_contains(pl, trim(x))) AS more FROM l)
SELECT page, md5(CASE WHEN p = '' THEN o WHEN o = '' OR len(more) = 0 THEN p ELSE p || chr(10) || chr(10) || '[OCR Merge]' || chr(10) || array_to_string(more, chr(10)) END) AS merged FROM m
""")
def ocr_merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal pages, and every document with its first line as the text that is there already."""
    docs = table(spark, sf_dir, "documents").select((1000 + F.col("doc_id")).alias("page"), F.element_at(F.split("text", "\n"), 1).alias("t"), F.col("text").alias("o"))
    rows = values(spark, _OCR, "page long, t string, o string").union(docs)
    return rows.select("page", F.md5(X.merged_lines(F.col("t"), F.col("o"))).alias("merged"))


_TERMS = list(SYNONYMS.items())


@query(f"""
SELECT q.id, q.t || coalesce(' ' || string_agg(s.v, ' ' ORDER BY s.n), '') AS expanded
FROM (SELECT id::BIGINT AS id, t FROM {sql_values(_QUESTIONS, "id, t")} {_TALK_SQL}) q LEFT JOIN (SELECT * FROM {sql_values([(i, k, v) for i, (k, v) in enumerate(_TERMS)], "n, k, v")}) s ON contains(lower(q.t), s.k) GROUP BY q.id, q.t
""")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_talk(spark, sf_dir, _QUESTIONS).select("id", X.expanded(F.col("t")).alias("expanded"))


# --- small functions -------------------------------------------------------------------------

_TRANSCRIPT_SQL = "regexp_replace(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^[A-Z][a-z]+(\\s+[A-Z][a-z]+){0,2}\\s+\\d{1,2}:\\d{2}$') AND NOT lower(x) IN ('ok', 'okay', 'yeah', 'yep', 'hmm', 'bye', 'thanks', 'thank you')), ' '), '\\s+', ' ', 'g')), '(?i)^(so|well|okay|ok|alright|all right)[,\\s]+', '')"


@query(f"SELECT id, md5({_TRANSCRIPT_SQL}) AS flat FROM (SELECT id::BIGINT AS id, t FROM {sql_values(_CHUNKS, 'id, t')} {_TALK_SQL})")
def transcript_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_talk(spark, sf_dir, _CHUNKS).select("id", F.md5(X.transcript(F.col("t"))).alias("flat"))


@query("""
SELECT doc_id, CASE WHEN safe THEN 'security' WHEN contains(low, 'policy') THEN 'policy' WHEN contains(low, 'recommend') THEN 'guidance' END AS topic,
  CASE WHEN safe AND (contains(low, 'mfa') OR contains(low, '2fa') OR contains(low, 'multi-factor')) THEN 'mfa_setup' WHEN safe AND contains(low, 'shared collection') THEN 'shared_collections' WHEN safe THEN 'password_management'
    WHEN contains(low, 'policy') THEN 'general' WHEN contains(low, 'recommend') THEN 'recommendation' END AS subtopic
FROM (SELECT *, contains(low, 'bitwarden') OR contains(low, 'password') OR contains(low, 'vault') AS safe FROM (
  SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'policy ' WHEN 1 THEN 'vault 2FA ' WHEN 2 THEN 'password ' WHEN 3 THEN 'We recommend ' ELSE '' END || text) AS low FROM documents))
""")
def topic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(x) for x in ("policy ", "vault 2FA ", "password ", "We recommend ", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    topic, sub = X.topic_pair(F.concat(lead, F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", topic.alias("topic"), sub.alias("subtopic"))


@query("""
SELECT o_orderkey, try_cast(replace(regexp_extract(t, '(?:^|[^\\d,.])(\\d{1,3}(?:,\\d{3})+(?:\\.\\d{2})?|\\d{2,7}(?:\\.\\d{2})?)\\s*(?:per year|annual|yearly)', 1), ',', '') AS DOUBLE) AS amount
FROM (SELECT o_orderkey, 'up to ' || CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || '.50 per year' WHEN 1 THEN '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ' annual' ELSE o_orderkey || ' monthly' END AS t FROM orders)
""")
def money_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit(".50 Per Year"))).when(key % 3 == 1, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" annual"))).otherwise(F.concat(key.cast("string"), F.lit(" monthly")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.annual_amount(F.concat(F.lit("up to "), said)).alias("amount"))


@query("""
SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(event_type || '_required a ' || event_type || '_required Zone_Required optional_' || user_id), '\\b([a-z_]{4,})\\b', 1), lambda t: ends_with(t, '_required')))), ',') AS tokens FROM events
""")
def unmapped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("event_type", F.lit("_required a "), "event_type", F.lit("_required Zone_Required optional_"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.required_tokens(said), ",").alias("tokens"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 260 THEN rtrim(left(text, 257)) || '...' ELSE text END) AS cut FROM documents")
def ellipsis_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.ellipsis(F.col("text"))).alias("cut"))


_SUBMITTED = "(SELECT conv_id, turn, lower(text) AS low, CASE WHEN turn % 2 = 0 THEN role END AS topic, CASE WHEN length(text) > 100 THEN text END AS cond, CASE WHEN turn % 3 = 0 THEN 'act' END AS act, CASE WHEN turn % 5 > 0 THEN text END AS quote FROM conversations)"


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, said = F.col("turn"), F.col("text")
    item = F.struct(F.when(turn % 2 == 0, F.col("role")).alias("topic"), F.lit(None).cast("string").alias("subtopic"), F.when(F.length(said) > 100, said).alias("condition_text"), F.when(turn % 3 == 0, "act").alias("action_text"), F.when(turn % 5 > 0, said).alias("source_quote"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("raw_text"), item.alias("item"))


_POINTS = "(CASE WHEN coalesce(topic, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(cond, '') <> '' THEN 1 ELSE 0 END + CASE WHEN act IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN contains(low, 'approval') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, '[0-9]') THEN 1 ELSE 0 END)"


@query(f"""
SELECT conv_id, turn, CASE WHEN {_POINTS} / 5 < 0.7 OR coalesce(topic, '') = '' OR act IS NULL THEN 'needs_clarification' WHEN coalesce(quote, '') = '' THEN 'needs_review' ELSE 'extracted' END AS status,
  CASE WHEN contains(low, 'approval') THEN 0 ELSE 1 END + CASE WHEN length(coalesce(cond, '')) < 8 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, '[0-9]') THEN 0 ELSE 1 END AS questions,
  array_to_string(list_filter([CASE WHEN coalesce(topic, '') = '' THEN 'topic' END, CASE WHEN coalesce(quote, '') = '' THEN 'source_quote' END, CASE WHEN act IS NULL AND coalesce(cond, '') = '' THEN 'action_text or condition_text' END], lambda x: x IS NOT NULL), ',') AS missing
FROM {_SUBMITTED}
""")
def submission_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = admin.judged(_submitted(spark, sf_dir))
    return judged.select("conv_id", "turn", "status", F.size("questions").alias("questions"), F.array_join("missing", ",").alias("missing"))


@query(f"""
SELECT conv_id, turn, coalesce(topic, 'General') AS topic, act AS action_text, md5(coalesce(nullif(quote, ''), text)) AS quote FROM (SELECT s.*, c.text FROM {_SUBMITTED} s JOIN conversations c USING (conv_id, turn))
WHERE NOT ({_POINTS} / 5 < 0.7 OR coalesce(topic, '') = '' OR act IS NULL)
""")
def admin_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = admin.judged(_submitted(spark, sf_dir)).withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    made, _ = admin.published(judged)
    of = lambda i: F.element_at(F.split("submission_id", ":"), i).cast("long")
    return made.select(of(1).alias("conv_id"), of(2).alias("turn"), "topic", "action_text", F.md5("source_quote").alias("quote"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([o_orderkey::VARCHAR, '12.5', o_custkey::VARCHAR], lambda x: x NOT IN (o_custkey::VARCHAR, '7')), ',') AS unsupported FROM orders
""")
def number_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    said = F.concat(F.lit("Pay "), text("o_orderkey"), F.lit(" or 12.5 to "), text("o_custkey"), F.lit("."))
    known = F.concat(F.lit("Rule 7 for "), text("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.filter(X.unsupported_numbers(said, known), lambda x: x != "7"), ",").alias("unsupported"))


@query("SELECT conv_id, turn, contains(lower(text), 'could not find') OR length(text) < 150 AS skips FROM conversations")
def verification_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.skips_verification(F.col("text")).alias("skips"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id || '.txt' WHEN page_id % 3 = 0 THEN 'title' ELSE 'document' END AS name FROM pages")
def source_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    uri = F.when(key % 2 == 0, F.concat(F.lit("file:///x/page%20"), key.cast("string"), F.lit(".txt"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.file_name(uri, F.when(key % 3 == 0, "title")).alias("name"))


@query("""
WITH l AS (SELECT doc_id, text, source, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ls FROM documents),
  q AS (SELECT *, list_filter(ls, lambda x: length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) >= 2) AS solid, list_filter(ls, lambda x: NOT (x = '' OR regexp_matches(x, '(?i)^page\\s+\\d+\\s*(\\|\\s*\\d+)?$') OR regexp_matches(x, '^[\\d\\s|/:.-]+$') OR len(string_split(x, ' ')) < 4)) AS quiet FROM l),
  m AS (SELECT *, trim(regexp_replace(array_to_string(quiet, ' '), '\\s+', ' ', 'g')) AS flat, array_to_string(quiet, chr(10)) AS merged FROM q)
SELECT doc_id, length(text) AS chars_text, length(source) AS chars_ocr, length(merged) AS chars_merged, len(regexp_extract_all(text, '\\[Detected Table ')) AS tables_detected, contains(merged, '[OCR Merge]') AS ocr_used,
  len(solid) AS text_lines, len(list_filter(solid, lambda x: contains(flat, x))) AS text_lines_covered, len(list_filter(solid, lambda x: NOT contains(flat, x))) AS text_lines_missing,
  1 AS ocr_lines, CASE WHEN contains(flat, source) THEN 1 ELSE 0 END AS ocr_lines_covered, CASE WHEN contains(flat, source) THEN 0 ELSE 1 END AS ocr_lines_missing FROM m
""")
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, their source as OCR, and what is left without noise lines as the merged text."""
    rows = table(spark, sf_dir, "documents").select(F.lit("file").alias("source"), F.col("doc_id").alias("page"), "text", F.col("source").alias("ocr_text"), X.quiet_lines(F.col("text")).alias("merged"))
    return pages.statistics(rows).drop("source").withColumnRenamed("page", "doc_id")


@query(f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
  near AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q.v::DOUBLE[]) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 100),
  worded AS (SELECT doc_id AS vec_id, score FROM (SELECT doc_id, {" + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in _TOKENS)} AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100)
SELECT vec_id, round(score, 4) AS score, kind FROM (SELECT vec_id, score, 0 AS kind FROM near UNION ALL SELECT vec_id, score::DOUBLE, 1 FROM worded WHERE vec_id NOT IN (SELECT vec_id FROM near))
""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred vectors nearest to a question's, and the hundred documents with most of its words, once each."""
    e, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    first = e.filter("vec_id = 0").select("embedding").first()  # the question's vector
    near = vector.topk(e, list(first[0]), 100, "vec_id", "embedding")
    worded = search.overlap_topk(docs, " ".join(_TOKENS), ("text",), ["doc_id"], 100).select(F.col("doc_id").alias("vec_id"), "score")
    return vector.hybrid(near, worded, "vec_id").withColumn("score", F.round("score", 4))


@query("SELECT doc_id, 'doc_' || left(sha256(source || chr(31) || doc_id), 32) AS id FROM documents")
def prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ingest.key_id("doc", F.col("source"), F.col("doc_id")).alias("id"))


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate, o_orderstatus, true AS flag FROM orders")
def json_safe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.lit(True).alias("flag")))


@query("SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10))) AS body FROM conversations")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.fence_stripped(fenced)).alias("body"))


_PAGE_WORDS = "list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_SIZES_SQL = f"""
WITH p AS (SELECT conv_id AS source, turn AS page, len({_PAGE_WORDS})::BIGINT AS n FROM conversations),
  b AS (SELECT source, 'per_page' AS method, page, n FROM p UNION ALL SELECT source, 'whole_document', NULL, sum(n)::BIGINT FROM p GROUP BY source),
  sizes AS (SELECT source, method, page, (i // 25)::INT AS at, least(30, n - i)::BIGINT AS words FROM (SELECT *, unnest(range(0, n, 25)) AS i FROM b))
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("page"), "text")


@query(_SIZES_SQL + "SELECT * FROM sizes")
def chunk_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every chunk of 30, 5 of them shared, by turn and through the conversation."""
    return profile.chunk_sizes(_turns(spark, sf_dir), 30, 5)


@query(_SIZES_SQL + "SELECT method, count(*) AS chunks, sum(words)::BIGINT AS words FROM sizes GROUP BY method")
def chunk_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks themselves, of turns and of whole conversations."""
    turns = _turns(spark, sf_dir)
    pages_ = turns.select(F.explode(X.word_chunks(F.col("text"), 30, 5)).alias("chunk"))
    whole = turns.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda t: t["text"]), "\n\n").alias("text"))
    return profile.chunk_comparison(pages_, whole.select(F.explode(X.word_chunks(F.col("text"), 30, 5)).alias("chunk")))


def _turn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the words of chunks by chunking, one a source and chunking."""
    return summaries.number_sketches(profile.chunk_sizes(_turns(spark, sf_dir), 30, 5), ["source", "method"], "words")


@query(_SIZES_SQL + "SELECT method, count(*) AS n, sum(words)::BIGINT AS total, min(words)::BIGINT AS least, max(words)::BIGINT AS most FROM sizes GROUP BY method")
def chunk_size_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merged sketches say without error."""
    return summaries.number_merged(_turn_sizes(spark, sf_dir), ["method"]).drop("ranks")


@query()
def chunk_size_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and the ends of the middle nine tenths of the words of a chunk, within the sketches' rank error."""
    return summaries.quantiles(summaries.number_merged(_turn_sizes(spark, sf_dir), ["method"]), ["method"], SHARES)


# --- publication -----------------------------------------------------------------------------

_STATE_SQL = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'blocked_schema' ELSE 'published' END"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staged rows: pending, blocked or published, some with a candidate that may not be published."""
    none = F.lit(None).cast("string")
    c = F.struct(F.col("o_orderkey").cast("string").alias("candidate_id"), (F.col("o_orderkey") % 2 == 0).alias("publishable"), F.lit(0.8).alias("confidence"), F.col("o_orderpriority").alias("topic"), *[none.alias(n) for n in ("subtopic", "condition_text", "action_text", "recommendation_text", "summary", "reason_if_not_publishable", "source_quote")])
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "blocked_schema").otherwise("published")
    one = F.struct(F.col("o_orderpriority").alias("value"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("extraction_id"), F.concat(F.lit("b"), (F.col("o_custkey") % 7).cast("string")).alias("batch_id"), F.lit("s").alias("section_id"), c.alias("candidate"), F.create_map(F.lit("topic"), one, F.lit("odd"), one).alias("mapped_fields"), F.lit(0.8).alias("confidence"), state.alias("status"))


@query(f"""
SELECT o_orderkey::VARCHAR AS extraction_id, CASE WHEN s = 'published' THEN s WHEN o_orderkey % 2 = 0 THEN 'published' ELSE 'skipped' END AS status,
  CASE WHEN s <> 'published' AND o_orderkey % 2 = 1 THEN 'chunk flagged non-publishable' END AS publish_error FROM (SELECT *, {_STATE_SQL} AS s FROM orders)
""")
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.decided(_gated(spark, sf_dir)).select("extraction_id", "status", "publish_error")


@query(f"""
SELECT o_orderkey::VARCHAR AS extraction_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (o_orderpriority = '1-URGENT')::VARCHAR END AS approval_required,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey + 0.5 END AS amount_threshold, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS wrong
FROM orders WHERE {_STATE_SQL} <> 'published' AND o_orderkey % 2 = 0
""")
def published_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rules with booleans and numbers: the flag has a column, the amount comes from the payload."""
    told = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN ' Yes' WHEN '2-HIGH' THEN 'f' ELSE 'perhaps' END")
    amount = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("$"), F.col("o_custkey").cast("string"), F.lit(".5"))).otherwise("much")
    one = lambda v: F.struct(v.alias("value"))
    mapped = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), F.create_map(F.lit("approval_required"), one(told), F.lit("amount_threshold"), one(amount)).alias("_mapped"))
    staged = _gated(spark, sf_dir).join(mapped, F.col("extraction_id") == F.col("_id")).withColumn("mapped_fields", F.col("_mapped"))
    rules_ = publish.typed(publish.published(staged, ["topic", "approval_required"]))
    return rules_.select("extraction_id", F.col("approval_required").cast("string").alias("approval_required"), "amount_threshold", F.size("field_errors").alias("wrong"))


@query(f"""
SELECT 'pub_' || left(sha256(id), 32) AS publish_id, id AS extraction_id, 'pol_' || left(sha256(id), 32) AS policy_id, topic FROM (
  SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS topic FROM orders WHERE {_STATE_SQL} <> 'published' AND o_orderkey % 2 = 0)
""")
def publish_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rules with their audit; mapped fields that the table lacks are left out."""
    made = publish.published(_gated(spark, sf_dir), ["policy_id", "section_id", "topic", "department"])
    return publish.audit(made).drop("created_at").join(made.select("extraction_id", "topic"), "extraction_id").select("publish_id", "extraction_id", "policy_id", "topic")


@query(f"""
SELECT batch_id, 'completed' AS status, count(*) AS extractions_total, '{{"total":' || count(*) || ',"pending":' || count(*) FILTER (WHERE s = 'pending') || ',"published":' || count(*) FILTER (WHERE s = 'published') || ',"skipped":0,"failed":0}}' AS result_summary
FROM (SELECT 'b' || (o_custkey % 7) AS batch_id, {_STATE_SQL} AS s FROM orders) GROUP BY 1
""")
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _gated(spark, sf_dir)
    batches = reduce(DataFrame.union, [publish.batch_row(spark, f"b{i}", "query") for i in range(7)])
    totals = publish.batch_totals(batches, staged.select("batch_id"), staged.select("batch_id"), staged)
    done = publish.batch_completion(totals, publish.batch_counters(staged))
    return done.select("batch_id", "status", "extractions_total", "result_summary")


@query("""
WITH RECURSIVE n AS (SELECT p_name || ' ' || p_brand AS name, count(*) AS n FROM part GROUP BY 1),
  g AS (SELECT name, n, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT *, '  ' || lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) || '  ' AS p FROM n)),
  links AS (SELECT a.name AS a, b.name AS b FROM g a, g b WHERE a.name <> b.name AND least(len(a.g), len(b.g)) >= 0.85 * greatest(len(a.g), len(b.g)) - 1e-9
    AND len(list_intersect(a.g, b.g)) >= 0.85 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) - 1e-9),
  reach AS (SELECT a AS name, a AS other FROM links UNION SELECT r.name, l.b FROM reach r JOIN links l ON l.a = r.other),
  best AS (SELECT name, first(other ORDER BY n DESC, other) AS canonical FROM reach JOIN (SELECT name AS other, n FROM n) USING (other) GROUP BY name)
SELECT n.name AS original, coalesce(canonical, n.name) AS canonical FROM (SELECT p_name || ' ' || p_brand AS name FROM part) n LEFT JOIN best USING (name)
""")
def name_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under their names and brands, those spelled alike renamed to the commonest of them."""
    named = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("original"))
    merged = ingest.renamed(named.withColumn("canonical", F.col("original")), "canonical", names.mapping(named, "original", 0.85), "original", "canonical")[0]
    return merged.select("original", "canonical")


# --- evolution -------------------------------------------------------------------------------

_CONCEPTS = ["annual_cap", "region_code", "exceptions", "Is_Billable", "custom_required"]


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _CONCEPTS])
    concept = F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))
    item = F.struct(concept.alias("raw_label"), F.lit("").alias("normalized_label"), F.array(F.col("event_type"), F.get_json_object("props", "$.k")).alias("observed_values"), F.lit("new_scalar").alias("suggested_classification"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 3).cast("int")).alias("frequency_in_batch"))
    return table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("extraction_id"), F.array(item).alias("unmapped_concepts"))


_GAP_SQL = """
SELECT concept, CASE WHEN concept IN ('is_billable', 'topic') THEN 'new_value' WHEN concept = 'exception_text' THEN 'new_relationship' WHEN concept = 'amount_threshold' THEN 'new_scalar' ELSE 'text_only' END AS gap_type, frequency
FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'amount_threshold' WHEN 1 THEN 'region_code' WHEN 2 THEN 'exception_text' WHEN 3 THEN 'is_billable' ELSE 'custom_required' END AS concept,
  sum(CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 1 END)::BIGINT AS frequency FROM events GROUP BY 1)
"""


@query(_GAP_SQL)
def gap_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.gaps(_staged(spark, sf_dir), dictionary(spark), ["is_billable", "topic"]).select("concept", "gap_type", "frequency")


@query("""
WITH i AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'amount_threshold' WHEN 1 THEN 'region_code' WHEN 2 THEN 'exception_text' WHEN 3 THEN 'is_billable' ELSE 'custom_required' END AS concept, [event_type, props->>'k'] AS seen FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY lpad(event_id::VARCHAR, 12, '0')) AS n FROM i)
SELECT concept, string_agg(array_to_string(seen, '|'), '|' ORDER BY n) AS examples FROM r WHERE n <= 2 GROUP BY 1
""")
def gap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item shows two values, so the first two items fill the list."""
    return evolve.gaps(_staged(spark, sf_dir), dictionary(spark), ["is_billable", "topic"]).select("concept", F.array_join("examples", "|").alias("examples"))


@query(f"""
SELECT migration_class, count(*) AS n, string_agg(concept, ',' ORDER BY concept) AS concepts FROM (
  SELECT concept, CASE WHEN gap_type = 'new_value' THEN 'safe_auto' ELSE 'approval_required' END AS migration_class FROM ({_GAP_SQL})) GROUP BY 1
""")
def proposal_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evolve.proposals(evolve.gaps(_staged(spark, sf_dir), dictionary(spark), ["is_billable", "topic"]), "bat_1")
    return made.select("migration_class", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda i: i["concept"]), ",").alias("concepts"))


@query("SELECT r_regionkey, r_name, NULL::VARCHAR AS region_code FROM region")
def schema_evolve_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.added(table(spark, sf_dir, "region"), ["region_code", "r_name"])


@query("SELECT o_custkey, value_text FROM (SELECT o_custkey::VARCHAR AS o_custkey, unnest([o_orderstatus, o_orderpriority]) AS value_text FROM orders)")
def child_table_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("v"))
    return evolve.child_table(o, "o_custkey", "v").select("o_custkey", "value_text")


# --- vectors ---------------------------------------------------------------------------------

@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v::DOUBLE[]) DESC, vec_id LIMIT 10
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()  # the question's vector
    return vector.topk(e, list(first[0]), 10, "vec_id", "embedding").select("vec_id", F.round("score", 4).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT q.id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS score FROM embeddings e, q)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, round(score, 4) AS score FROM s QUALIFY rank <= 10
""")
def vector_topk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector as a question its ten nearest, itself included."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return vector.topk_table(e, asked, 10, "vec_id", "embedding", "question_id", 64).withColumn("score", F.round("score", 4))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(ids, "vec_id", "left_semi")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.run(resolved_orders(spark, sf_dir), _SPEC)[0]


QUERIES["flagship"], ORACLES["flagship"] = flagship, ORACLES["spec_search_standard"]
