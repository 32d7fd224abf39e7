"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import null_safe
from shelfmark.llm.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest one, or itself."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    m = F.least("m", "u")
    return (
        both.where("v > u")
        .join(least, F.col("u").eqNullSafe(F.col("n")))
        .select(F.col("v").alias("a"), m.alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    tied = down.join(least, null_safe(down, least, [("u", "n")]))
    return (
        tied.where("v != m")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select("n", "m"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node of
    ``edges`` (columns ``a``, ``b``, any orientation) that is not a root itself.

    Alternates two steps until the edges are stars around the roots. A step
    ties a node to one other, so the edges never become more; a node with very
    many neighbours is a skewed join key, and both joins are in the form that
    adaptive execution splits.
    Every round is written to the shared folder.
    """
    edges = staged(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = None
    while True:
        after = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if after == before or not after[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
        edges = staged(_small_star(_large_star(edges)), "edges")
