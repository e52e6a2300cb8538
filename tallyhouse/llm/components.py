"""Connected components of a graph given as links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import saved


def _apart(least: DataFrame) -> DataFrame:
    """Minima with their node as an expression: they are shuffled anew, so Spark can split the very many links of one node in a join."""
    return least.withColumn("a", F.col("a").bitwiseXOR(F.lit(0).cast("long")))


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b. Neighbours are never gathered, only their minimum."""
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    large = both.where("b > a").join(_apart(least), "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("_least"))
    joined = large.join(_apart(lowest), "a").where("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return joined.union(lowest).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def roots(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node that is not the smallest itself.

    `links` has two columns of longs; direction, repeats and loops do not matter. Every round is written to the
    shared folder, and only a count and a checksum come back, so rounds end when nothing changes.
    """
    a, b = (F.col(c) for c in links.columns)
    current = saved(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    before = _state(current)
    while before[0]:
        current = saved(_stars(current), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    return current.toDF("node", "root")
