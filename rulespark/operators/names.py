"""Merging names that are spelled alike: a similarity join on q-grams, components of the links, the commonest name of each.

Names are compared in lower case, white space collapsed and two blanks around, by the Jaccard similarity
of their parts of three characters. Two names that reach the threshold share a part among the rarest few
of either, so they are joined on those prefixes only, and within the sizes that can reach it.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions.text import collapse

GRAM = 3
THRESHOLD = 0.7


def parts(name: Column) -> Column:
    """The distinct parts of three characters, with two blanks before and after."""
    padded = F.concat(F.lit("  "), F.lower(collapse(name)), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: padded.substr(i, F.lit(GRAM))))


def alike(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of every two different names, a < b, whose similarity is ``threshold`` or more. ``names``: (name), each once."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    sets = names.select("name", parts(F.col("name")).alias("parts"))
    rarity = sets.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    each = sets.select("name", F.explode("parts").alias("part")).join(rarity, "part")
    # a name's own parts are few; the rarest come first, in one order for all names
    ordered = each.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]).alias("parts"))
    size = F.size("parts")
    least = F.ceil(size * threshold - 1e-9).cast("int")
    prefix = ordered.select("name", "parts", size.alias("size"), F.explode(F.slice("parts", F.lit(1), size - least + 1)).alias("part"))
    a, b = (prefix.select(F.col("name").alias(s), F.col("parts").alias(f"{s}_parts"), F.col("size").alias(f"{s}_size"), "part") for s in ("a", "b"))
    near = (F.col("a") < F.col("b")) & (F.col("a_size") >= F.col("b_size") * threshold - 1e-9) & (F.col("b_size") >= F.col("a_size") * threshold - 1e-9)
    shared = F.size(F.array_intersect("a_parts", "b_parts"))
    # of the prefix parts that two names share, only their first meets them
    first = F.element_at(F.array_intersect(F.slice("a_parts", F.lit(1), _prefix("a", threshold)), F.slice("b_parts", F.lit(1), _prefix("b", threshold))), 1)
    pairs = a.join(b, "part").filter(near & (F.col("part") == first)).select("a", "b", (shared / (F.col("a_size") + F.col("b_size") - shared)).alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold - 1e-9)


def _prefix(side: str, threshold: float) -> Column:
    size = F.col(f"{side}_size")
    return size - F.ceil(size * threshold - 1e-9).cast("int") + 1


def cut(df: DataFrame) -> DataFrame:
    """The rows checkpointed in the folder that ``spark.checkpoint.dir`` names; only a local master may do without one."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="rulespark-"))
    return df.checkpoint()


def groups(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(name, group): each linked name with the least name that it reaches over ``links`` (a, b).

    A round gives each name the least group among its neighbours' and its own, and then the group of that
    group, so that the rounds grow with the logarithm of a chain.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("name"), F.least("a", "least").alias("group")))
    for _ in range(rounds):
        seen = both.join(now, F.col("b") == F.col("name")).groupBy("a").agg(F.min("group").alias("near"))
        wider = now.join(seen, F.col("name") == F.col("a")).select("name", F.least("group", "near").alias("group"), F.col("group").alias("before"))
        further = wider.select(F.col("name").alias("_of"), F.col("group").alias("_to"))
        after = cut(wider.join(further, F.col("group") == F.col("_of"), "left").select("name", F.least("group", F.coalesce("_to", "group")).alias("group"), "before"))
        now = after.select("name", "group")
        if after.filter(F.col("group") != F.col("before")).isEmpty():
            return now
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def mapping(df: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """(original, canonical) for ``ingest.renamed``: every name that is spelled like others becomes the commonest of its group.

    Of equally common names it is the least. Names that are like none, and the commonest themselves, are
    not in the result; null and blank names take no part. Groups are chained: two names of a group may be
    less alike than the threshold.
    """
    counts = df.filter(F.trim(column) != "").groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    grouped = groups(alike(counts.select("name"), threshold)).join(counts, "name")
    best = grouped.groupBy("group").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("canonical"))
    return grouped.join(best, "group").filter("name <> canonical").select(F.col("name").alias("original"), "canonical")
