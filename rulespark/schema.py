"""Names, types and the concept dictionary of the rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Filter keys, fields, concepts and aliases of the rule table.
FILTER_KEYS = (
    "policy_category", "topic", "subtopic", "document_id", "batch_id", "applies_to", "department", "employee_type",
    "activity_type", "bill_to", "charge_code", "approval_required", "approver", "status", "receipt_required",
    "annual_cap", "region_code", "approval_frequency",
)
FIELDS = (
    "document_id", "batch_id", "summary", "policy_category", "topic", "subtopic", "applies_to", "department",
    "employee_type", "activity_type", "condition_text", "action_text", "bill_to", "charge_code", "is_billable",
    "approval_required", "approver", "deadline_text", "amount_threshold", "threshold_unit", "exception_text",
    "consequence_text", "source_quote", "status", "receipt_required", "annual_cap", "region_code", "approval_frequency",
    "policy_precedence", "override_policy_id",
)
TYPE_HINTS = {
    "policy_category": "enum_like",
    "topic": "text",
    "subtopic": "text",
    "applies_to": "enum_like",
    "department": "enum_like",
    "employee_type": "enum_like",
    "activity_type": "enum_like",
    "condition_text": "text",
    "action_text": "text",
    "bill_to": "enum_like",
    "charge_code": "enum_like",
    "is_billable": "bool",
    "approval_required": "bool",
    "approver": "relationship",
    "deadline_text": "text",
    "amount_threshold": "numeric",
    "threshold_unit": "enum_like",
    "exception_text": "relationship",
    "consequence_text": "text",
    "source_quote": "text",
    "status": "enum_like",
}
ALIASES = {
    "annual_cap": "amount_threshold",
    "yearly_cap": "amount_threshold",
    "annual_limit": "amount_threshold",
    "receipt_required": "approval_required",
    "multiple_approvers": "approver",
    "exceptions": "exception_text",
}
RESERVED = {"category_type", "approvers", "yearly_cap", "annual_limit", "exceptions"}
#: Texts that mean yes and no.
YES, NO = ("true", "t", "yes", "1"), ("false", "f", "no", "0")

# Question vocabulary.
SYNONYMS = {
    "pd": "professional development",
    "client dinner": "meal expense client meeting expense category",
    "holiday party": "voluntary social event",
    "proposal time": "bid proposal activity",
    "tqc": "total quality control",
    "teqc": "total quality control",
    "what do i put this under": "expense category",
    "what category": "expense category",
    "timesheet category": "activity type timesheet",
    "charge this": "expense category or billing category",
}
EXPENSE_TERMS = ("client dinner", "dinner", "meal", "meals", "expense", "expenses", "travel")
LIST_TERMS = ("holidays", "categories", "activity codes", "activities", "options")
KEYWORD_STOPS = {
    "what", "when", "where", "which", "how", "should", "could", "would", "from", "into", "with", "and", "for", "that", "this", "have", "your", "the",
}

# Rules in order, the first that holds is taken. A rule holds if each of its groups has a
# (text, terms) whose text contains a term; "padded" is the question between two spaces, "compact" that
# with white space collapsed.
INTENTS = (
    ("approval_requirement", [[("compact", ["approval"])]]),
    ("timesheet_activity", [[("compact", ["timesheet"])], [("compact", ["activity", "select"])]]),
    ("expense_category", [[("compact", ["category", "categorize"])]]),
    ("expense_category", [[("compact", ["how do i charge"])], [("compact", EXPENSE_TERMS)]]),
    ("complete_list", [[("compact", ["what are"])], [("padded", [" all "]), ("compact", LIST_TERMS)]]),
    ("procedure_steps", [[("compact", ["how do i", "steps", "submit"])]]),
    ("definition", [[("compact", ["what is", "define"])]]),
    ("eligibility", [[("compact", ["can i", "allowed"])]]),
)
QUESTION_CATEGORIES = (
    ("marketing", [[("low", ["marketing"])]]),
    ("billing", [[("low", ["bill", "charge"])]]),
    ("payroll", [[("low", ["payday", "payroll"])]]),
    ("overtime", [[("low", ["overtime"])]]),
    ("travel", [[("low", ["travel", "expense"])]]),
)
QUESTION_ACTIVITIES = (
    ("internal marketing", [[("low", ["internal marketing"])]]),
    ("client campaign", [[("low", ["campaign"])]]),
    ("weekend overtime", [[("low", ["weekend"])]]),
)

#: Types of the staged payload, as DDL.
CANDIDATE = (
    "struct<candidate_id:string,document_id:string,section_id:string,chunk_type:string,publishable:boolean,summary:string,topic:string,"
    "subtopic:string,condition_text:string,action_text:string,recommendation_text:string,entities:array<string>,source_quote:string,"
    "reason_if_not_publishable:string,rule_text:string,confidence:double,extractor_version:string>"
)
MAPPED = "map<string,struct<value:string,value_type:string,confidence:double,provenance:string>>"
UNMAPPED = "array<struct<raw_label:string,normalized_label:string,observed_values:array<string>,suggested_classification:string,frequency_in_batch:int>>"


def type_hint(concept: str) -> str:
    return TYPE_HINTS.get(concept, "text")


def read_dictionary(text: str) -> tuple[dict[str, str], dict[str, str], set[str]]:
    """(type hints by concept, canonical names by alias, reserved names) of a YAML dictionary.

    It has ``concepts`` (name: type_hint, synonyms, reserved_names) and ``mapping_rules`` (alias: name),
    which go over synonyms. Needs the optional YAML library on the driver.
    """
    import yaml

    payload = yaml.safe_load(text) or {}
    if not isinstance(payload, dict):
        raise ValueError("a dictionary is an object with concepts and mapping_rules")
    clean = lambda x: str(x).strip().lower()
    concepts = {name: raw or {} for name, raw in (payload.get("concepts") or {}).items()}
    hints = {name: str(raw.get("type_hint") or "text") for name, raw in concepts.items()}
    aliases = {clean(s): name for name, raw in concepts.items() for s in raw.get("synonyms") or [] if clean(s)}
    aliases |= {clean(a): str(t).strip() for a, t in (payload.get("mapping_rules") or {}).items()}
    return hints, aliases, {clean(r) for raw in concepts.values() for r in raw.get("reserved_names") or []}


def dictionary(spark: SparkSession, overrides: DataFrame | None = None, hints: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(alias, canonical, type_hint): every concept under its own name and its aliases, by default the built-in ones.

    ``overrides`` (alias, canonical, active) replace entries of the same alias; inactive rows are ignored.
    """
    hints, aliases = TYPE_HINTS if hints is None else hints, ALIASES if aliases is None else aliases
    rows = [(c.lower(), c, h) for c, h in hints.items() if c.lower() not in aliases] + [(a, c, hints.get(c, "text")) for a, c in aliases.items()]
    base = spark.createDataFrame(rows, "alias string, canonical string, type_hint string")
    if overrides is None:
        return base
    live = overrides.filter("active").selectExpr("lower(trim(alias)) as alias", "lower(trim(canonical)) as canonical").dropDuplicates(["alias"])
    hints = base.select("canonical", "type_hint").dropDuplicates(["canonical"])
    live = live.join(hints, "canonical", "left").select("alias", "canonical", F.coalesce("type_hint", F.lit("text")).alias("type_hint"))
    return base.join(live, "alias", "left_anti").union(live)


#: Changes to the dictionary that a store keeps, as DDL.
OVERRIDES = "canonical_name string, aliases array<string>, reserved_names array<string>, mapping_rules map<string,string>, active boolean"


def overridden(table: DataFrame) -> DataFrame:
    """(alias, canonical, active) of a table of ``OVERRIDES``, for ``dictionary``; of two rows that name an alias, mapping rules win."""
    named = table.filter("trim(canonical_name) <> ''")
    synonyms = named.select(F.explode("aliases").alias("alias"), F.col("canonical_name").alias("canonical"), "active", F.lit(1).alias("_rank"))
    rules = named.select(F.explode("mapping_rules").alias("alias", "canonical"), "active").select("alias", "canonical", "active", F.lit(0).alias("_rank"))
    every = synonyms.union(rules).filter("active and trim(alias) <> '' and trim(canonical) <> ''").withColumn("alias", F.lower(F.trim("alias")))
    return every.groupBy("alias").agg(F.min_by("canonical", F.struct("_rank", "canonical")).alias("canonical")).withColumn("active", F.lit(True))


def names_of(table: DataFrame | None) -> tuple[set[str], dict[str, str], set[str]]:
    """(concepts, canonical names by alias, reserved names), the built-in ones with those of a table of ``OVERRIDES``: a dictionary, small by nature."""
    if table is None:
        return set(TYPE_HINTS), dict(ALIASES), set(RESERVED)
    aliases = {r.alias: r.canonical.strip() for r in overridden(table).collect()}
    live = table.filter("active and trim(canonical_name) <> ''")
    reserved = {r.n for r in live.select(F.explode("reserved_names").alias("n")).select(F.lower(F.trim("n")).alias("n")).distinct().collect() if r.n}
    return set(TYPE_HINTS) | {r.n for r in live.select(F.trim("canonical_name").alias("n")).distinct().collect()}, ALIASES | aliases, RESERVED | reserved
