"""Hooks for external models. Each is a plain function of the caller's; without one, rules decide.

``planner(question, context) -> JSON text``, ``extractor(text) -> JSON text``, ``formatter(question, rows,
intent) -> text``, ``topics([(topic, rows)]) -> {topic: canonical}``, ``embedder([text]) -> [vector]``.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.operators import names, profile
from rulespark.schema import CANDIDATE

from . import spec
from .spec import SearchSpec

Planner = Callable[[str, str], str]
Extractor = Callable[[str], str]
Formatter = Callable[[str, list[dict], str], str]
Topics = Callable[[list[tuple[str, int]]], dict[str, str]]
Embedder = Callable[[list[str]], list[list[float]]]

# The columns whose values a planner is told.
CONTEXT_COLUMNS = ("topic", "subtopic", "policy_category", "department", "employee_type", "activity_type", "status")


def unfenced(reply: str | None) -> str:
    """A reply without its Markdown code fence."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = re.sub(r"\n?[ \t]*```\s*\Z", "", re.sub(r"\A```[^\n]*\n?", "", text)).strip()
    return text


def parsed(reply: str | None) -> dict:
    text = unfenced(reply)
    if not text:
        raise ValueError("the planner's reply is empty")
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"the planner's reply is not JSON: {e}") from e


def rule_planner(question: str, context: str = "") -> str:
    """A specification from the context alone: the longest listed topic that the question names."""
    low = f" {' '.join(re.findall(r'[a-z0-9]+', question.lower()))} "
    topics = re.findall(r"^topic: (.*)$", context, re.M)
    named = [t for t in topics if f" {' '.join(re.findall(r'[a-z0-9]+', t.lower()))} " in low]
    filters = {"topic": max(named, key=len)} if named else {}
    return json.dumps({"table": spec.TABLE, "filters": filters})


def planned(question: str, planner: Planner | None = None, context: str = "") -> SearchSpec:
    """The validated specification of a planner's reply, adjusted to the question's intent."""
    if not (question or "").strip():
        raise ValueError("the question is empty")
    wide = spec.expand(question.strip())
    return spec.with_intent(spec.validate(parsed((planner or rule_planner)(wide, context))), spec.intent_of(wide))


def context(policies: DataFrame) -> str:
    """Distinct values of the filter columns, a line each, for a planner; 300 lines at most."""
    total = policies.count()
    if not total:
        return "rows: 0"
    columns = [c for c in CONTEXT_COLUMNS if c in policies.columns]
    return told(total, profile.snapshot(policies, columns))


def told(total: int, shown: DataFrame) -> str:
    """The context's lines from the number of rows and (col, val), the values to be named."""
    rows = shown.orderBy("col", "val").limit(300).collect()
    return "\n".join([f"rows: {total}", *[f"{r.col}: {r.val}" for r in rows]])


class Cached:
    """The value of ``make``, made again when it is older than ``seconds``."""

    def __init__(self, make: Callable[[], str], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self._make, self._seconds, self._clock, self._made = make, seconds, clock, None

    def __call__(self) -> str:
        now = self._clock()
        if self._made is None or now - self._made[0] > self._seconds:
            self._made = now, self._make()
        return self._made[1]


def extracted(sections: DataFrame, extractor: Extractor, text: str = "section_text") -> DataFrame:
    """The sections with ``model`` (a candidate) from the extractor; null where it fails or its reply is no JSON object."""

    def run(frames):
        for f in frames:
            replies = []
            for t in f[text]:
                try:
                    value = json.loads(unfenced(extractor(t or "")))
                    replies.append(json.dumps(value) if isinstance(value, dict) else None)
                except Exception:  # whatever the model's client raises, the rules decide
                    replies.append(None)
            yield f.assign(model=pd.Series(replies, index=f.index, dtype=object))

    out = sections.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in sections.dtypes)}, model string")
    return out.withColumn("model", F.from_json("model", CANDIDATE))


# The fields that a model's candidate maps, and where they come from.
MODEL_FIELDS = (("topic", "llm:topic"), ("subtopic", "llm:subtopic"), ("condition_text", "llm:condition"), ("action_text", "llm:action"))


def with_model(staged: DataFrame, sections: DataFrame, extractor: Extractor, version: str = "model-1") -> DataFrame:
    """Staged rows of ``ingest.extracted`` with the extractor's candidates in place of the rules', where they keep the contract.

    A candidate needs a chunk type, a flag, a summary and a confidence from 0 to 1; else, and for complete lists,
    the rules' row stays as it is. Ids, and quote and rule text that the model leaves out, are the rules'.
    The mapped fields are those that the model names; a recommendation stands in for an action.
    """
    said = extracted(sections.select("section_id", "section_text"), extractor).select("section_id", "model").dropDuplicates(["section_id"])
    of, own = (lambda n: F.col(f"model.{n}")), (lambda n: F.col(f"candidate.{n}"))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    sound = F.coalesce(of("publishable").isNotNull() & of("confidence").between(0, 1) & full(of("chunk_type")).isNotNull() & full(of("summary")).isNotNull(), F.lit(False)) & (own("chunk_type") != "policy_list")
    kept = ("candidate_id", "document_id", "section_id")
    filled = {n: F.coalesce(full(of(n)), own(n)) for n in ("source_quote", "rule_text")} | {n: own(n) for n in kept} | {"extractor_version": F.lit(version)}
    names = [f.name for f in staged.schema["candidate"].dataType.fields]
    candidate = F.struct(*[filled.get(n, of(n)).alias(n) for n in names])
    value = {n: full(of(n)) for n, _ in MODEL_FIELDS} | {"action_text": F.coalesce(full(of("action_text")), full(of("recommendation_text")))}
    source = {n: F.lit(p) for n, p in MODEL_FIELDS} | {"action_text": F.when(full(of("action_text")).isNotNull(), "llm:action").otherwise("llm:recommendation")}
    entry = lambda n: F.when(value[n].isNotNull(), F.struct(F.lit(n).alias("key"), F.struct(value[n].alias("value"), F.lit("string").alias("value_type"), of("confidence").alias("confidence"), source[n].alias("provenance")).alias("value")))
    mapped = F.map_from_entries(F.array_compact(F.array(*[entry(n) for n, _ in MODEL_FIELDS])))
    new = {"candidate": candidate, "mapped_fields": mapped, "unmapped_concepts": F.slice("unmapped_concepts", 1, 0), "confidence": of("confidence")}
    kinds = dict(staged.dtypes)  # without "not null", which the model's fields are not
    return staged.join(said, "section_id", "left").select(*[F.when(sound, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in staged.columns])


def formatted(question: str, rows: list[dict], intent: str, formatter: Formatter | None = None) -> str:
    """The formatter's answer in sections; that of the rules without rows, without a formatter or if it fails.

    A reply that finds nothing, though there are rows, becomes an answer from related rows; one without
    the sections becomes the direct answer among those of the rows.
    """
    if rows and formatter is not None:
        try:
            if reply := (formatter(question, rows, intent) or "").strip():
                return profile.related(rows) if profile.NOT_FOUND.lower() in reply.lower() else profile.structured(reply, rows)
        except Exception:  # as above
            pass
    return profile.answer(rows)


def topic_mapping(spark: SparkSession, policies: DataFrame, topics: Topics | None = None, most: int = 10_000) -> DataFrame:
    """(original, canonical) for ``ingest.renamed``, from the topics and their counts; unknown or blank names are dropped.

    Without a model, topics that are spelled alike become the commonest of them. A model is asked about
    ``most`` topics at most; a table with more is an error.
    """
    if topics is None:
        return names.mapping(policies, "topic")
    known = [(r.topic, r.n) for r in profile.breakdown(policies, "topic", non_blank=True).limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"more than {most} topics for a model")
    listed = {t for t, _ in known}
    pairs = [(k, v.strip()) for k, v in topics(known).items() if k in listed and isinstance(v, str) and v.strip()]
    return spark.createDataFrame(pairs, "original string, canonical string")


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = 16) -> DataFrame:
    """The rows with ``embedding``, asked for ``batch`` texts at a time; null for a blank text."""

    def run(frames):
        for f in frames:
            texts = f[text].fillna("").tolist()
            wanted = [i for i, t in enumerate(texts) if t.strip()]
            found = [None] * len(texts)
            for a in range(0, len(wanted), batch):
                some = wanted[a : a + batch]
                for i, v in zip(some, embedder([texts[i] for i in some]), strict=True):
                    found[i] = [float(x) for x in v]
            yield f.assign(embedding=pd.Series(found, index=f.index, dtype=object))

    return rows.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, embedding array<float>")
