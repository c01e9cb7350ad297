"""Connected components by alternating large-star and small-star steps, all on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Beyond so many edges minima are written before they are joined to neighbourhoods. Both sides of the
#: join are then plain shuffles, in which Spark splits a hub that many nodes point to.
SPLIT = 1_000_000


def _stars(edges: DataFrame, both: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v). Large star looks at all neighbours and moves the greater ones; small star at smaller ones."""
    if both:
        sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = sides.join(least, "u")
    if both:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    ``edges`` has two columns of one orderable type; loops, repeated edges and nulls are ignored.
    No neighbourhood is gathered: minima are aggregated before the shuffle, and joined back to edges.
    An empty edge table gives an empty result. Fails if ``max_rounds`` do not converge.
    """
    a, b = edges.columns
    now = scratch.save(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    size = now.count()
    if not size:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(max_rounds):
        written: list[DataFrame] = []

        def keep(minima: DataFrame) -> DataFrame:
            if size <= SPLIT:  # noqa: B023
                return minima
            written.append(scratch.save(minima))  # noqa: B023
            return written[-1]  # noqa: B023

        after = scratch.save(_stars(_stars(now, True, keep).filter("u <> v").distinct(), False, keep).filter("u <> v").distinct())
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now, *written)
        now, size = after, seen[0]
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
