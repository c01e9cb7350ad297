"""Chunk cuts by prefix sums: each jump to the next cut is a binary search, so time is linear in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lines import BLANKS

_WORD = re.compile(f"[^{BLANKS}]+")
_BREAK = re.compile(f"\n[{BLANKS}]*\n")
_END = re.compile("\r\n?")


def cuts(sizes: np.ndarray, size: int) -> list[int]:
    """Where packs begin, and the end: items in order while the sum of their sizes stays within ``size``, one at least."""
    ends = np.cumsum(sizes)
    out, at = [0], 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        out.append(at)
    return out


def packs(items: list[str], sizes: np.ndarray, size: int, joint: str) -> list[str]:
    at = cuts(sizes, size)
    return [joint.join(items[a:b]) for a, b in zip(at[:-1], at[1:])]


def by_chars(text: str, size: int) -> list[str]:
    """Words packed greedily while the sum of their lengths plus one each stays within ``size`` characters."""
    words = _WORD.findall(text)
    return packs(words, np.fromiter(map(len, words), np.int64, len(words)) + 1, size, " ")


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines, stripped, without empty ones."""
    return [p for p in (x.strip(BLANKS) for x in _BREAK.split(_END.sub("\n", text).strip(BLANKS))) if p]


def by_paragraphs(text: str, least: int, most: int) -> list[str]:
    """Whole paragraphs packed up to ``most`` words; a last pack under ``least`` joins the one before if both fit in ``least + most``."""
    count = lambda t: len(_WORD.findall(t))
    parts = paragraphs(text)
    out = packs(parts, np.array([count(p) for p in parts], np.int64), most, "\n\n")
    if len(out) > 1 and (last := count(out[-1])) < least and last + count(out[-2]) <= least + most:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def column(text: Column, chunk, *args: int) -> Column:
    """``chunk`` of each text, in Arrow batches; null texts have no chunks."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([chunk(t or "", *args) for t in texts], dtype=object)

    return run(F.coalesce(text, F.lit("")))
