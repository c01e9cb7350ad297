"""Summaries of values that merge: made once for each part of a table, put together without reading the parts again.

A part's row for a column has the count of rows and of filled ones, the first values in order, and three
sketches. The first values of a whole are among those of its parts, so they stay exact. The other
figures have errors:

* ``differing``: the standard error is 1.04 / sqrt(2 ** LG), 1.6 %.
* ``frequent``: counts are off by at most 3.5 / 2048 of the filled rows (for TRACKED = 1000), and not at
  all for a column of up to 1500 values; a value is listed only if it must be among the frequent ones.
* quantiles of numbers: the rank is off by at most 0.7 % of the rows (for RANKS = 400) in 99 of 100 cases.

Exact counts are read for named values only (``counted``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precision of the distinct counts; items the frequency sketches keep; size of the quantile sketches.
LG, TRACKED, RANKS = 12, 1000, 400
#: Values of a column that are kept in order.
FIRST = 100
#: Largest error of a count of a frequent value, as a share of the filled rows.
FREQUENT_ERROR = 3.5 / 2048


def _first(values: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, first): the ``most`` first distinct values of ``val``."""
    w = Window.partitionBy(*keys).orderBy("val")
    # the rank limit drops all but ``most`` rows a task before they are dealt out
    few = values.distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list("val")).alias("first"))


def summarized(df: DataFrame, columns: list[str], part: Column | str, most: int = FIRST) -> DataFrame:
    """(part, col, n_rows, filled, first, differing, frequent) for every part and column that has rows.

    Values are trimmed text; null and blank ones are not filled. ``part`` is the value that tells the
    parts apart; null is one. A column that the table lacks has no filled rows.
    """
    wanted = list(dict.fromkeys(columns))
    cell = lambda c: F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")
    text = lambda c: F.nullif(F.trim(cell(c)), F.lit("")).alias(c)
    of = (F.col(part) if isinstance(part, str) else part).cast("string")
    long = df.select(of.alias("_part"), *[text(c) for c in wanted]).unpivot(["_part"], wanted, "col", "val").withColumnRenamed("_part", "part")
    figures = long.groupBy("part", "col").agg(
        F.count("*").alias("n_rows"), F.count("val").alias("filled"), F.hll_sketch_agg("val", LG).alias("differing"),
        F.expr(f"approx_top_k_accumulate(val, {TRACKED}) FILTER (WHERE val IS NOT NULL)").alias("frequent"),
    )
    first = _first(long.filter("val is not null"), ["part", "col"], most).withColumnsRenamed({"part": "_part", "col": "_col"})
    joined = figures.join(first, F.col("part").eqNullSafe(F.col("_part")) & (F.col("col") == F.col("_col")), "left")
    return joined.select("part", "col", "n_rows", "filled", F.coalesce("first", F.array().cast("array<string>")).alias("first"), "differing", "frequent")


def merged(parts: DataFrame, most: int = FIRST, top: int = 10) -> DataFrame:
    """(col, n_rows, filled, first, differing, frequent): ``differing`` a count, ``frequent`` the ``top`` values with theirs, most frequent first."""
    figures = parts.groupBy("col").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("differing")).alias("differing"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {TRACKED}), {top})").alias("frequent"),
    )
    first = _first(parts.select("col", F.explode("first").alias("val")), ["col"], most)
    ranked = F.transform(F.array_sort(F.transform("frequent", lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("val")))), lambda x: F.struct(x["val"].alias("val"), (-x["less"]).alias("n")))
    return figures.join(first, "col", "left").select("col", "n_rows", "filled", F.coalesce("first", F.array().cast("array<string>")).alias("first"), "differing", ranked.alias("frequent"))


def values(whole: DataFrame) -> DataFrame:
    """(col, val) of merged summaries: what ``profile.snapshot`` reads from the table itself."""
    return whole.select("col", F.explode("first").alias("val"))


def counted(df: DataFrame, column: str, named: list[str]) -> DataFrame:
    """(val, n): exact counts of the named values, spelled as in the table but for outer spaces."""
    clean = F.trim(F.col(f"`{column}`").cast("string"))
    return df.filter(clean.isin(*named)).groupBy(clean.alias("val")).agg(F.count("*").alias("n")) if named else df.limit(0).select(clean.alias("val"), F.lit(0).cast("long").alias("n"))


def number_sketches(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, total, least, most, ranks) of the whole numbers of a column; nulls do not count, and a group of nulls has null figures."""
    number = F.col(f"`{value}`").cast("long")
    return df.groupBy(*by).agg(F.count(number).alias("n"), F.sum(number).alias("total"), F.min(number).alias("least"), F.max(number).alias("most"), F.kll_sketch_agg_bigint(number, F.lit(RANKS)).alias("ranks"))


def number_merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of parts as those of wholes: ``by`` a part of their columns."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_bigint("ranks").alias("ranks"))


def quantiles(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, n, total, least, most, quantiles): a number for each share from 0 to 1; null without numbers."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("ranks", wanted))
    return sketches.select(*by, "n", "total", "least", "most", found.alias("quantiles"))
