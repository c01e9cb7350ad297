"""Text functions as Column expressions over higher-order functions.

Patterns and word lists are fixed values of the rule vocabulary. Nulls are read as empty unless a
function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rulespark.functions import chunks
from rulespark.functions.lines import line_cover as _line_cover
from rulespark.functions.lines import page_cover as _page_cover
from rulespark.functions.lines import merged as _merged
from rulespark.schema import INTENTS, QUESTION_ACTIVITIES, QUESTION_CATEGORIES, SYNONYMS

# Classification patterns in order, base confidences, list heads, fillers, entity names.
CHUNK_PATTERNS = (
    ("action_item", r"\b(action item|follow up|owner|todo)\b"),
    ("recommendation", r"\b(recommend|suggest|best practice)\b"),
    ("definition", r"\b(defined as|definition|means)\b"),
)
RULE_IF, RULE_MUST = r"\b(if|when)\b", r"\b(should|must|required|need to|cannot|can't)\b"
PROCEDURE = r"\b(first|next|then|go to|click|set up|enable|open)\b"
ASKS = r"\b(how|what|why|where|when)\b"
COURTESY = r"\b(thank you|thanks|bye|hmm|okay|ok)\b"
INSTRUCTION = r"\b(go to|click|open|select|import|export|set up|enable|disable|use)\b"
BASE_CONFIDENCE = {"policy_list": 0.9, "policy_rule": 0.72, "procedure": 0.68, "recommendation": 0.66, "action_item": 0.64, "definition": 0.62, "faq": 0.58, "discussion": 0.45, "transcript_metadata": 0.35, "filler": 0.2}
PUBLISHABLE_TYPES = ("policy_list", "policy_rule", "procedure", "recommendation", "definition", "faq", "action_item")
LIST_HEADS = r"(?i)(holidays?|categor(y|ies)|tools?|requirements?|activities|activity codes?)"
LIST_TOPICS = (("holiday", "Holidays"), ("categor", "Categories"), ("activit", "Activities"), ("tool", "Tools"), ("requirement", "Requirements"))
ITEM = r"^([-*•]|\d+[.)]|[A-Za-z][.)])\s+(.+)$"
ITEM_WORDS = r"(?i)\b(day|holiday|category|activity|requirement|tool|approval|time)\b"
FILLERS = ("ok", "okay", "yeah", "yep", "hmm", "bye", "thanks", "thank you")
SPEAKER = r"^[A-Z][a-z]+(\s+[A-Z][a-z]+){0,2}\s+\d{1,2}:\d{2}$"
NOT_NAMES = ("So", "All", "That", "This", "And", "But", "If", "Then", "OK", "Yep", "Yeah", "Thanks", "Thank")
ENTITY_NAMES = ("Bitwarden", "Microsoft Edge", "OneLogin", "MFA", "CSV")
RAW_LABELS = ("annual_cap", "yearly_cap", "annual_limit", "receipt_required")
OBLIGATION = r"(?i)\b(should|must|required|need to|cannot|can't|recommend(?:ed)?)\b"
NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(present(text), r"\s+", " "))


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(present(text), r"\r\n?", "\n"), "\n")


def words(text: Column) -> Column:
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there: an array's element is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_count(text: Column) -> Column:
    """Words parted by white space."""
    return F.size(words(text))


def sections(text: Column, keep_preamble: bool = False) -> Column:
    """array<struct<heading, body>>: parts under #, ## or ### headings, else paragraphs ``Section n``.

    Empty bodies are dropped; so is text before the first heading, unless it is to be kept.
    """
    whole = F.trim(F.regexp_replace(present(text), r"^\s+|\s+$", ""))
    parts = F.split(whole, r"(?m)^(?=#{1,3}[ \t]+\S)")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    headed = F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^#{1,3}\s"), strip(F.regexp_extract(p, r"^#{1,3}\s+([^\n]*)", 1))).otherwise(F.lit("Preamble" if keep_preamble else None).cast("string")).alias("heading"), strip(F.when(p.rlike(r"^#{1,3}\s"), F.regexp_replace(p, r"^[^\n]*\n?", "")).otherwise(p)).alias("body")))
    paragraphs = F.filter(F.transform(F.split(whole, r"\n{2,}"), strip), lambda p: p != "")
    numbered = F.transform(paragraphs, lambda p, i: F.struct(F.concat(F.lit("Section "), (i + 1).cast("string")).alias("heading"), p.alias("body")))
    kept = F.filter(headed, lambda s: s["heading"].isNotNull() & (s["body"] != ""))
    return F.when(whole.rlike(r"(?m)^#{1,3}[ \t]+\S"), kept).otherwise(numbered)


def char_chunks(text: Column, size: int) -> Column:
    """Words packed greedily while the sum of their lengths plus one each stays within ``size`` characters."""
    return chunks.column(text, chunks.by_chars, size)


def paragraph_chunks(text: Column, least: int = 120, most: int = 180) -> Column:
    """Whole paragraphs packed up to ``most`` words; a last pack under ``least`` joins the one before if both fit in ``least + most``."""
    return chunks.column(text, chunks.by_paragraphs, least, most)


def word_chunks(text: Column, size: int, overlap: int, least: int = 0) -> Column:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the one before; those under ``least`` words go."""
    step = size - max(0, min(overlap, size - 1))
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    kept = lambda w: F.filter(starts(w), lambda i: F.size(w) - i >= least) if least else starts(w)
    return bound(words(text), lambda w: F.transform(kept(w), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")))


def quiet_lines(text: Column, least_words: int = 4) -> Column:
    """Lines with blank, page-number, punctuation-only and very short lines removed."""
    noise = lambda x: (x == "") | x.rlike(r"(?i)^page\s+\d+\s*(\|\s*\d+)?$") | x.rlike(r"^[\d\s|/:.-]+$") | (F.size(F.split(x, " ")) < least_words)
    return F.array_join(F.filter(F.transform(lines(text), collapse), lambda x: ~noise(x)), "\n")


@F.pandas_udf(StringType())
def joined_glyphs(texts: pd.Series) -> pd.Series:
    """"A u g u s t" as "August" and "2 0 2 5" as "2025"; the replacement depends on the match, so it is Pandas."""
    squeeze = lambda m: "".join(m.group(0).split())
    return texts.fillna("").str.replace(r"\b(?:[A-Za-z]\s+){2,}[A-Za-z]\b", squeeze, regex=True).str.replace(r"\b(?:\d\s+){2,}\d\b", squeeze, regex=True)


def transcript(text: Column) -> Column:
    """One line of prose: without speaker stamps, fillers and a leading discourse marker."""
    kept = F.filter(F.transform(lines(text), collapse), lambda x: (x != "") & ~x.rlike(SPEAKER) & ~F.lower(x).isin(*FILLERS))
    return F.regexp_replace(collapse(F.array_join(kept, " ")), r"(?i)^(so|well|okay|ok|alright|all right)[,\s]+", "")


def summary(text: Column, limit: int = 220) -> Column:
    """The first sentence, or all if that is under 24 characters, cut at ``limit``."""
    clean = transcript(text)
    first = F.element_at(F.split(clean, r"(?<=[.!?])\s+", 2), 1)
    best = F.when(F.length(first) >= 24, first).otherwise(clean)
    return F.when(F.length(best) <= limit, best).otherwise(F.concat(F.rtrim(F.substring(best, 1, limit)), F.lit("...")))


def entities(text: Column, limit: int = 6) -> Column:
    """Title-case names of two or three words, then known products, in order and once each."""
    t = present(text)
    names = F.filter(F.regexp_extract_all(t, F.lit(NAME), 1), lambda n: ~F.element_at(F.split(n, r"\s+"), 1).isin(*NOT_NAMES))
    known = F.array_compact(F.array(*[F.when(t.rlike(rf"\b{n}\b"), F.lit(n)) for n in ENTITY_NAMES]))
    return F.slice(F.array_distinct(F.concat(names, known)), 1, limit)


def chunk_type(text: Column) -> Column:
    low = F.lower(F.regexp_replace(present(text), r"^\s+|\s+$", ""))
    short = F.size(F.split(collapse(low), " ")) <= 12
    out = F.when(low == "", "filler").when(low.contains("started transcription") | low.contains("stopped transcription") | low.rlike(r"^[a-z]+\s+\d{1,2}:\d{2}$"), "transcript_metadata").when(low.rlike(COURTESY) & short, "filler")
    for name, pattern in CHUNK_PATTERNS:
        out = out.when(low.rlike(pattern), name)
    return out.when(low.rlike(RULE_IF) & low.rlike(RULE_MUST), "policy_rule").when(low.rlike(PROCEDURE), "procedure").when(low.contains("?") & low.rlike(ASKS), "faq").otherwise("discussion")


def by_rules(rules: tuple, texts: dict[str, Column], otherwise: str | None) -> Column:
    """The first name of ``schema`` rules whose alternatives hold; a rule's alternatives are lists of groups, all of which need one term."""
    has = lambda where, terms: reduce(lambda a, b: a | b, [texts[where].contains(t) for t in terms])
    holds = lambda groups: reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [has(where, terms) for where, terms in group]) for group in groups])
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, groups in rules:
        out = out.when(holds(groups), name)
    return out.otherwise(F.lit(otherwise).cast("string"))


def intent(question: Column) -> Column:
    """The intent of a question, by the rules of ``schema``."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(present(question))), F.lit(" "))
    return by_rules(INTENTS, {"compact": collapse(padded), "padded": padded}, "fallback")


def expanded(question: Column) -> Column:
    """The question with the expansions of the terms it contains, in vocabulary order."""
    found = F.array_compact(F.array(*[F.when(F.lower(question).contains(k), F.lit(v)) for k, v in SYNONYMS.items()]))
    return F.array_join(F.concat(F.array(question), found), " ")


def question_class(question: Column) -> Column:
    """struct<policy_category, activity_type> of a question by plain substring rules; billing and null without a match."""
    low = {"low": F.lower(present(question))}
    return F.struct(by_rules(QUESTION_CATEGORIES, low, "billing").alias("policy_category"), by_rules(QUESTION_ACTIVITIES, low, None).alias("activity_type"))


def fence_stripped(text: Column) -> Column:
    """A reply without its Markdown code fence: the first line, and the last if it is a fence too."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    t = strip(present(text))
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```\s*$", ""))).otherwise(t)


def _first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def condition(text: Column, strict_sentence: bool = False) -> Column:
    """From if or when to the next comma or semicolon; sentences end it only if ``strict_sentence``."""
    t = transcript(text)
    pattern = r"(?i)\b(if|when)\b(.+?)(,|;" + (r"|\.\s|\.$)" if strict_sentence else ")")
    return F.nullif(F.concat(_first_upper(F.regexp_extract(t, pattern, 1)), F.trim(F.regexp_extract(t, pattern, 2))), F.lit(""))


def action(text: Column, strict_sentence: bool = False) -> Column:
    """From the first obligation word to the next semicolon or the end."""
    t = transcript(text)
    pattern = OBLIGATION + r"(.+?)(;|$" + (r"|\.\s|\.$)" if strict_sentence else ")")
    return F.nullif(F.concat(_first_upper(F.regexp_extract(t, pattern, 1)), F.trim(F.regexp_extract(t, pattern, 2))), F.lit(""))


def topic_pair(text: Column) -> tuple[Column, Column]:
    low = F.lower(present(text))
    safe = low.contains("bitwarden") | low.contains("password") | low.contains("vault")
    topic = F.when(safe, "security").when(low.contains("policy"), "policy").when(low.contains("recommend"), "guidance")
    factor = low.contains("mfa") | low.contains("2fa") | low.contains("multi-factor")
    sub = F.when(safe & factor, "mfa_setup").when(safe & low.contains("shared collection"), "shared_collections").when(safe, "password_management").when(low.contains("policy"), "general").when(low.contains("recommend"), "recommendation")
    return topic, sub


def annual_amount(text: Column) -> Column:
    """The amount before per year, annual or yearly, read with its thousands; null without one."""
    found = F.regexp_extract(F.lower(present(text)), r"(?:^|[^\d,.])(\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d{2,7}(?:\.\d{2})?)\s*(?:per year|annual|yearly)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def list_text(text: Column) -> Column:
    """Bullets on lines of their own, also where OCR read bullets as `` e ``, and after ``head: item``."""
    t = F.regexp_replace(F.regexp_replace(present(text), r"\r\n?", "\n"), r"[•◦▪▫]\s*", "\n- ")
    parts = F.filter(F.transform(F.split(t, r"\s+e\s+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    itemlike = F.size(F.filter(parts, lambda p: p.rlike(ITEM_WORDS))) >= 3
    t = F.when((F.regexp_count(t, F.lit(r"\s+e\s+")) >= 2) & itemlike, F.array_join(parts, "\n- ")).otherwise(t)
    t = F.regexp_replace(t, r"(?im)^([^:\n]*(?:holidays?|categor(?:y|ies)|tools?|requirements?|activities|activity codes?)[^:\n]*):[ \t]+([^-*\n].+)$", "$1:\n- $2")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def list_items(cleaned: Column) -> Column:
    rows = F.filter(F.transform(lines(cleaned), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(ITEM))
    items = F.transform(rows, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_extract(x, ITEM, 2), r"^[ ;,]+|[ ;,]+$", ""), r"\s+", " "))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def list_heading(cleaned: Column) -> Column:
    """The first line with a list head that has a colon or stands before an item; null without one."""
    rows = F.filter(F.transform(lines(cleaned), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    after = lambda i: F.coalesce(F.get(rows, i + 1), F.lit("")).rlike(r"^([-*•]|\d+[.)]|[A-Za-z][.)])\s+")
    heads = F.filter(rows, lambda x, i: x.rlike(LIST_HEADS) & (x.contains(":") | after(i)))
    first = F.get(heads, F.lit(0))
    return F.when(first.contains(":"), F.trim(F.element_at(F.split(first, ":"), 1))).otherwise(F.trim(first))


def list_topic(heading: Column) -> Column:
    low = F.lower(heading)
    out = F.when(heading.isNull(), F.lit(None).cast("string"))
    for part, name in LIST_TOPICS:
        out = out.when(low.contains(part), name)
    return out.otherwise(F.initcap(heading))


def merged_lines(page: Column, ocr: Column) -> Column:
    """The page's text, then the OCR lines that it does not hold verbatim; blank OCR lines stay."""
    return _merged(present(page), present(ocr))


def solid_lines(text: Column) -> Column:
    """Lines with at least two ASCII letters or digits, white space collapsed."""
    return F.filter(F.transform(lines(text), collapse), lambda x: F.length(F.regexp_replace(x, "[^A-Za-z0-9]", "")) >= 2)


def line_cover(source: Column, merged: Column) -> Column:
    """struct<solid, lost>: the number of a source's solid lines, and those its merged text does not hold, repeats included."""
    return _line_cover(present(source), present(merged))


def uncovered_lines(source: Column, merged: Column) -> Column:
    """The solid lines of a source that its merged text does not hold, repeats included."""
    return line_cover(source, merged)["lost"]


def covered_lines(source: Column, merged: Column) -> Column:
    return bound(line_cover(source, merged), lambda c: c["solid"] - F.size(c["lost"]))


def page_statistics(text: Column, ocr: Column, merged: Column) -> Column:
    """A struct of lengths, table marks, and the solid lines of the text and of the OCR that the merged text holds or lacks."""
    plain = [F.length(present(c)).alias(f"chars_{n}") for n, c in (("text", text), ("ocr", ocr), ("merged", merged))]
    plain += [F.regexp_count(present(text), F.lit(r"\[Detected Table ")).alias("tables_detected"), present(merged).contains("[OCR Merge]").alias("ocr_used")]
    counted = lambda c, n: [c[f"{n}_lines"].alias(f"{n}_lines"), (c[f"{n}_lines"] - c[f"{n}_lost"]).alias(f"{n}_lines_covered"), c[f"{n}_lost"].alias(f"{n}_lines_missing")]
    # both covers once, however many counts are taken from them; lines do not come back, only their counts
    return bound(_page_cover(present(text), present(ocr), present(merged)), lambda c: F.struct(*plain, *counted(c, "text"), *counted(c, "ocr")))


def markdown_table(cells: Column, number: Column) -> Column:
    """A detected table (rows of cells) as Markdown, its first row the header; empty without rows."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.trim(present(c))), " | "), F.lit(" |"))
    rule = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.lit("---")), " | "), F.lit(" |"))
    head = F.concat(F.lit("[Detected Table "), number.cast("string"), F.lit("]"))
    body = lambda t: F.array_join(F.concat(F.array(head, F.lit(""), row(F.element_at(t, 1)), rule(F.element_at(t, 1))), F.transform(F.slice(t, 2, F.greatest(F.lit(1), F.size(t))), row)), "\n")
    return F.when(F.size(F.coalesce(cells, F.array().cast("array<array<string>>"))) > 0, bound(cells, body)).otherwise(F.lit(""))


def required_tokens(text: Column) -> Column:
    """Distinct sorted tokens of letters and underscores that end in ``_required``."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(present(text)), F.lit(r"\b([a-z_]{4,})\b"), 1), lambda t: t.endswith("_required"))))


def ellipsis(text: Column, limit: int = 260) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def file_name(url: Column, title: Column, fallback: str = "document") -> Column:
    """The last part of a ``file://`` address, else the title, else the fallback."""
    name = F.when(url.startswith("file://"), F.element_at(F.split(F.url_decode(url), "/"), -1))
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(title, F.lit("")), F.lit(fallback))


def skips_verification(answer: Column, refusal: str = "could not find", least: int = 150) -> Column:
    low = F.lower(present(answer))
    return low.contains(refusal) | (F.length(low) < least)


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Numbers of the answer that the context does not hold."""
    numbers = lambda c: F.regexp_extract_all(present(c), F.lit(r"(\d+(?:\.\d+)*)"), 1)
    return F.array_except(numbers(answer), numbers(context))
