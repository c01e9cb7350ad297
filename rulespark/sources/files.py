"""Text, binary, JSON and rule-table sources."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_uri, text): whole UTF-8 files, folders read recursively."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("text"))


def documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(source_uri, kind, text, error): .txt, .docx and .pdf files of a folder; other suffixes are left out.

    A file that cannot be read, or whose library is missing on the executors, has a null text and the
    reason. ``readers`` add to the readers by suffix, or replace them.
    """
    every = {"txt": _plain, "docx": _docx, "pdf": _pdf} | (readers or {})
    return reduce(DataFrame.union, [texts_of(spark, path, f"*.{kind}", kind, read) for kind, read in every.items()]).orderBy("source_uri")


def texts_of(spark: SparkSession, path: str, pattern: str, kind: str, read: Callable[[bytes], str]) -> DataFrame:
    def attempt(data: bytes) -> tuple[str | None, str | None]:
        try:
            return read(bytes(data)), None
        except Exception as e:  # a library's errors for damaged files have no common base
            return None, f"{type(e).__name__}: {e}"

    def run(frames):
        for f in frames:
            got = [attempt(b) for b in f["content"]]
            yield pd.DataFrame({"source_uri": f["path"], "kind": kind, "text": [t for t, _ in got], "error": [e for _, e in got]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "source_uri string, kind string, text string, error string")


def _plain(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def _docx(data: bytes) -> str:
    """The paragraphs of the main part, read from the package itself: it is a ZIP of XML parts."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml"))
    marks = {f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n"}
    texts = ["".join(x.text or "" if x.tag == f"{space}t" else marks.get(x.tag, "") for x in p.iter()).strip() for p in body.iter(f"{space}p")]
    if not any(texts):
        raise ValueError("the document has no text")
    return "\n\n".join(t for t in texts if t)


def _pdf(data: bytes) -> str:
    from .pages import pdf_reader

    return "\n\n".join(t for p in pdf_reader(data, dpi=None) if (t := "\n\n".join(b[2].strip() for b in sorted(p["blocks"]) if b[2].strip())))


def local_path(uri: str | None) -> str | None:
    """The file a driver-side address names: ``file://`` unquoted, or a path that exists; else None."""
    if not (uri or "").strip():
        return None
    if uri.startswith("file://"):
        return unquote(uri.removeprefix("file://"))
    return uri if os.path.exists(uri) else None


def path_of(uri: Column) -> Column:
    """``file://`` addresses as unquoted paths; other addresses are null, as no task can tell whether they exist."""
    return F.when(uri.startswith("file://"), F.url_decode(F.regexp_replace(uri.substr(F.lit(8), F.length(uri)), r"\+", "%2B")))


def jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. ``limit`` keeps the first rows for a quick evaluation."""
    rows = spark.read.schema(schema).json(path)
    return rows.limit(limit) if limit else rows


def rule_tables(spark: SparkSession, path: str) -> DataFrame:
    """(sec, title, version, key, label, value, units, note): one row an item of each rule-table file."""
    schema = "sec string, title string, version string, items array<struct<key:string,label:string,value:string,units:string,note:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select("sec", "title", "version", F.inline("items"))


def cached_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ``published_rows_all`` of a batch report, for use when the rule table cannot be read."""
    return spark.read.schema(f"published_rows_all array<struct<{schema}>>").option("multiLine", "true").json(path).select(F.inline("published_rows_all"))
