"""Retrieval plans over the rule table: resolved fields, filters, sibling closure, fallbacks."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spec import LIMIT, LIST_LIMIT, SCOPE, SearchSpec, empty, keywords, list_terms, relaxations

# The fields that fall back to staging when blank, are compared without case, or are searched as text.
BLANK_AWARE = ("topic", "subtopic", "condition_text", "action_text", "source_quote")
CASELESS = ("topic", "subtopic")
OFFLINE_TEXT = ("summary", "topic", "subtopic", "condition_text", "action_text", "recommendation_text", "source_quote")
RANK = "_rank"
LIST_TEXT = ("topic", "subtopic", "summary", "condition_text", "action_text", "source_quote", "policy_category")


def filled(first: Column, *others: Column) -> Column:
    """The first value if it is neither null nor blank-empty, else the others in turn."""
    return F.coalesce(F.nullif(first, F.lit("")), *others)


def resolved_policies(policies: DataFrame, audit: DataFrame, staging: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Every policy with its published extraction, section and document; one lazy plan, built once.

    The audit's status stays in the join condition, so unpublished policies remain; several published
    audit rows give several rows. ``staging.candidate`` is a struct.
    """
    p, a, s, sec, d = policies.alias("p"), audit.alias("a"), staging.alias("s"), sections.alias("sec"), documents.alias("d")
    text = lambda c: F.col(c).cast("string")
    joined = (
        p.join(a, (F.col("a.policy_id") == text("p.policy_id")) & (F.col("a.publish_status") == "published"), "left")
        .join(s, F.col("s.extraction_id") == F.col("a.extraction_id"), "left")
        .join(sec, text("sec.section_id") == text("p.section_id"), "left")
        .join(d, text("d.document_id") == text("sec.document_id"), "left")
    )
    own = {"document_id": F.coalesce(text("s.document_id"), text("d.document_id")), "batch_id": F.coalesce("s.batch_id", "d.batch_id"), "summary": F.coalesce("s.candidate.summary", "p.condition_text", "p.action_text")}
    own |= {c: filled(F.col(f"p.{c}"), F.col(f"s.candidate.{c}")) for c in BLANK_AWARE}
    rest = [F.col(f"p.`{c}`") for c in policies.columns if c not in own]
    # rules are ranked by their own columns, not by what they resolve to
    return joined.select(*rest, *[e.alias(c) for c, e in own.items()], completeness(F.col("p.condition_text"), F.col("p.action_text")).alias(RANK))


def predicate(key: str, value: object) -> Column | None:
    """One filter: caseless for topics, null-tolerant for the category, membership for lists; empty values give none."""
    if empty(value):
        return None
    column = F.col(key)
    many = list(value) if isinstance(value, (list, tuple)) else [value]
    if key in CASELESS:
        column, many = F.lower(column), [str(v).lower() for v in many]
    test = column.isin(many) if len(many) > 1 or isinstance(value, (list, tuple)) else column == many[0]
    return test | column.isNull() if key == "policy_category" else test


def conjunction(filters: dict[str, object]) -> Column:
    tests = [t for k in sorted(filters) if (t := predicate(k, filters[k])) is not None]
    return reduce(and_, tests, F.lit(True))


def blob(columns: tuple[str, ...]) -> Column:
    """The columns in lower case, joined by spaces, nulls as empty."""
    return F.concat_ws(" ", *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def contains_any(text: Column, terms: list[str], wildcards: bool = True) -> Column:
    """Whether any term stands in the text; with ``wildcards``, ``_`` and ``%`` in a term match as in LIKE."""
    low = [t.lower() for t in terms]
    return reduce(or_, [text.like(f"%{t}%") if wildcards else text.contains(t) for t in low], F.lit(False)) if low else F.lit(True)


def completeness(condition: Column, action: Column) -> Column:
    """0 for rules with condition and action, 1 for an action alone, 2 for a condition alone, else 3; blank is not null."""
    return F.when(condition.isNotNull() & action.isNotNull(), 0).when(action.isNotNull(), 1).when(condition.isNotNull(), 2).otherwise(3)


def metadata_contains(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the given texts, without regard to case; empty values give no test."""
    tests = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(v.lower()) for c, v in sorted(filters.items()) if not empty(v)]
    return df.filter(reduce(and_, tests, F.lit(True)))


def project(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """The requested fields, each a plain identifier and a column of the table; others are errors."""
    bad = [f for f in spec.fields if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f) or f not in df.columns]
    if bad:
        raise ValueError(f"fields that cannot be selected: {bad}")
    return df.select(*spec.fields)


def standard(resolved: DataFrame, spec: SearchSpec, limit: int = LIMIT) -> DataFrame:
    """Rows that pass all filters, the most complete rules first."""
    rank = F.col(RANK) if RANK in resolved.columns else completeness(F.col("condition_text"), F.col("action_text"))
    return project(resolved.filter(conjunction(spec.filters)).orderBy(rank, "policy_id").limit(limit), spec)


def complete_list(resolved: DataFrame, spec: SearchSpec, limit: int = LIST_LIMIT) -> DataFrame:
    """Rows in scope that contain a list term, with all rows of their documents and sections.

    Siblings come from matches anywhere; only the result is held to the scope.
    """
    scope = {k: v for k, v in spec.filters.items() if k in ("status", *SCOPE)}
    hit = contains_any(blob(LIST_TEXT), list_terms(spec))
    # one set of keys with what each is a key of (1 document, 2 section), so that both joins share its shuffle;
    # the sort-merge or broadcast choice is left to AQE's measured sizes
    text = lambda c: F.col(c).cast("string")
    named = F.array(*[F.struct(F.lit(bit).alias("kind"), text(c).alias("key")) for bit, c in ((1, "document_id"), (2, "section_id"))])
    hits = resolved.filter(hit).select(F.explode(named).alias("x")).select("x.*").filter("key is not null").groupBy("key").agg(F.bit_or("kind").alias("kinds"))
    keys = lambda bit, name: hits.filter(F.col("kinds").bitwiseAND(bit) > 0).select(F.col("key").alias(name))
    marked = resolved.join(keys(1, "_doc"), text("document_id") == F.col("_doc"), "left").join(keys(2, "_sec"), text("section_id") == F.col("_sec"), "left")
    wanted = marked.filter(conjunction(scope) & (hit | F.col("_doc").isNotNull() | F.col("_sec").isNotNull()))
    return project(wanted.orderBy(F.col("topic").asc_nulls_last(), F.col("subtopic").asc_nulls_last(), "policy_id").limit(limit), spec)


def keyword_fallback(resolved: DataFrame, spec: SearchSpec, question: str, limit: int = LIMIT, columns: tuple[str, ...] = ("summary", "action_text", "topic", "source_quote")) -> DataFrame | None:
    """Rows in scope whose texts contain a keyword of the question; None without keywords."""
    words = keywords(question)
    if not words:
        return None
    scope = {k: v for k, v in spec.filters.items() if k in ("status", *SCOPE)}
    found = resolved.filter(conjunction(scope) & contains_any(blob(columns), words))
    return project(found.orderBy("policy_id").limit(limit), spec)


def overlap_topk(rows: DataFrame, question: str, columns: tuple[str, ...] | list[str], order: list[str], limit: int = 10) -> DataFrame:
    """The rows that contain most tokens of the question (four characters at least, repeats count)."""
    tokens = [w for w in re.findall(r"[a-z0-9_]+", question.lower()) if len(w) >= 4]
    text = blob(columns)
    score = reduce(lambda a, b: a + b, [F.when(text.contains(t), 1).otherwise(0) for t in tokens], F.lit(0))
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), *order).limit(limit) if tokens else rows.withColumn("score", F.lit(0)).orderBy(*order).limit(limit)


def run(resolved: DataFrame, spec: SearchSpec, question: str = "") -> tuple[DataFrame, int]:
    """The rows of the first plan that has any, and the number of relaxations it took (-1: keywords)."""
    plan = complete_list if spec.intent == "complete_list" else standard
    fallback = keyword_fallback(resolved, spec, question)
    steps = [*enumerate([plan(resolved, wider) for wider in [spec, *relaxations(spec)]]), *([(-1, fallback)] if fallback is not None else [])]
    for step, found in steps:
        # at most 80 rows: read once, and handed over as they are
        rows = found.collect()
        if rows:
            return resolved.sparkSession.createDataFrame(rows, found.schema), step
    return steps[-1][1].limit(0), steps[-1][0]
