"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslens.llm.common import written


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("at")).agg(F.min(other).alias("low"))


def _large(edges: DataFrame) -> DataFrame:
    """Hooks every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = _least(both, "u", "v")
    return (both.filter("v > u").join(low, F.col("u") == F.col("at"))
            .select(F.least("low", "u").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Hooks a node and its smaller neighbours to the least of them; edges here run from small ``a`` to large ``b``."""
    low = _least(edges, "b", "a")
    hooked = edges.join(low, F.col("b") == F.col("at")).select(F.col("low").alias("a"), F.col("a").alias("b"))
    return hooked.unionByName(low.select(F.col("low").alias("a"), F.col("at").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node it can reach.

    Rounds end when one changes nothing; every round's table is written, and only its
    number of rows and a sum of hashes come to the driver. No group of links is gathered:
    the least neighbour is an aggregate, joined back to the links.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        edges = written(_small(_large(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
