"""Lines of one text that another holds, in time linear in both: one pass of an automaton over the text.

White space is that of ASCII, as in the patterns of ``functions.text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Type objects, as DDL would need a session when the module is imported.
COVER = StructType([StructField("solid", IntegerType()), StructField("lost", ArrayType(StringType()))])
COUNTS = StructType([StructField(f"{n}_{c}", IntegerType()) for n in ("text", "ocr") for c in ("lines", "lost")])
BLANKS = " \t\n\x0b\f\r"
_RUN = re.compile(f"[{BLANKS}]+")
_END = re.compile("\r\n?")
_SOLID = re.compile("[A-Za-z0-9][^A-Za-z0-9]*[A-Za-z0-9]")


def split(text: str) -> list[str]:
    return _END.sub("\n", text).split("\n")


def collapsed(text: str) -> str:
    return _RUN.sub(" ", text).strip(" ")


def solid(text: str) -> list[str]:
    """Lines with at least two ASCII letters or digits, white space collapsed."""
    return [line for line in map(collapsed, split(text)) if _SOLID.search(line)]


def held(patterns: set[str], text: str) -> set[str]:
    """The patterns (none of them blank) that stand in the text, by one Aho-Corasick pass over it that ends once all are found.

    The pass is linear in the text and in the matches; only patterns that are endings of each other
    match at one place together.
    """
    import ahocorasick

    found: set[str] = set()
    if patterns:
        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for _, p in automaton.iter(text):
            found.add(p)
            if len(found) == len(patterns):
                break
    return found


def cover(source: str, merged: str) -> tuple[int, list[str]]:
    """(number of solid lines of the source, those that the merged text does not hold, repeats included)."""
    lines = solid(source)
    # lines that are lines of the merged text need no search
    others = set(lines).difference(map(collapsed, split(merged)))
    lost = others - held(others, collapsed(merged))
    return len(lines), [line for line in lines if line in lost]


def merge(page: str, ocr: str) -> str:
    """The page, then the OCR lines that are none of its lines; blank OCR lines stay."""
    page, lines = page.strip(BLANKS), [line.rstrip(BLANKS) for line in split(ocr.strip(BLANKS))]
    if not page:
        return "\n".join(lines)
    have = {line.strip(BLANKS) for line in split(page)}
    more = [line for line in lines if not line or line.strip(BLANKS) not in have]
    return f"{page}\n\n[OCR Merge]\n" + "\n".join(more) if more and any(lines) else page


@F.pandas_udf(COVER)
def line_cover(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for source, text in parts:
        yield pd.DataFrame([cover(s, t) for s, t in zip(source, text, strict=True)], columns=["solid", "lost"])


@F.pandas_udf(StringType())
def merged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for page, ocr in parts:
        yield pd.Series([merge(p, o) for p, o in zip(page, ocr, strict=True)], dtype=object)


@F.arrow_udf(COUNTS)
def page_cover(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of a page's text and of its OCR, the solid lines and those that the merged text does not hold: counts only, and one row's texts at a time."""
    for columns in parts:
        made = []
        for text, ocr, whole in zip(*columns, strict=True):
            merged = whole.as_py()
            (a, lost), (b, more) = cover(text.as_py(), merged), cover(ocr.as_py(), merged)
            made.append((a, len(lost), b, len(more)))
        yield pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.int32()) for i in range(4)], names=[f.name for f in COUNTS])
