"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs. Returns (id, root) for every id with a link to another; root is the component's smallest id.

    Each round is two stars: an id's larger neighbours, then its smaller ones, are linked to the smallest it knows.
    Rounds grow with the logarithm of a component's size. Every round is a written table. The other side of both joins
    has each id once, so the hub of a large star makes no more rows than it has links; adaptive execution splits it.

    Defined results: links with a null end are left out, as are those of an id to itself; repeated links count once; an
    empty table gives an empty result.
    """
    edges = common.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null").distinct(), "links")
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = common.written(small.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), "links")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
