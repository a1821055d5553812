"""Connected components of an undirected graph, by alternating large and small stars.

Edges stay a Spark table; each round is a few joins and groupings over it and is written to the
shared folder, so a lost executor costs one round at most. Rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.text import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"),
                  F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return r["n"], r["h"], r["x"]


def _round(e: DataFrame) -> DataFrame:
    """A large star, then a small star."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    return (large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lower.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (columns a, b) but the roots themselves; the root of a
    component is its smallest id."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u <> v").distinct(), "edges")
    before = None
    while (now := _state(e)) != before:
        before = now
        e = written(_round(e).distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links (a, b) between its ids or others: only the links between
    different components count, one a pair of components, so a family's links collapse first."""
    of = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(ends)
    above = tops.select(F.col("id").alias("root"), F.col("root").alias("top"))
    return written(roots.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(tops), "roots")
