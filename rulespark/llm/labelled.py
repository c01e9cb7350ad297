"""Bounded samples of labelled rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def training_ids(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(did, label): at most ``per_class`` rows of each class outside the held-out fold, by hash order.

    Rows with a null id or a label other than 0 and 1 are left out; an id labelled twice counts once
    and an id with both labels not at all. The bound is what allows the result to be broadcast.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("did"), F.col(label).cast("int").alias("label")).filter("did is not null and label in (0, 1)")
    rows = rows.filter(fold("did") != 0).groupBy("did").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    part = lambda c: rows.filter(F.col("label") == c).orderBy(F.xxhash64("did"), "did").limit(per_class).select("did", "label")
    return part(0).union(part(1))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, text, label) of the sample, by a broadcast of its bounded list of ids; one row an id, of several texts the least."""
    ids = F.broadcast(training_ids(labels, label, per_class, id_col))
    texts = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(ids, "did").groupBy("did", "label").agg(F.min("text").alias("text")).select("did", "text", "label")
