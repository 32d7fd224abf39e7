"""How is a collection, or its use, spread over the values of an attribute?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.names import as_list, reject_clash


def _curve(counts: DataFrame) -> DataFrame:
    """Values per count, largest count first, with running totals.

    The window has no partitions, but its rows are the different counts: N
    items make fewer than sqrt(2 N) of them, 1.5 million for 10**12 items.
    """
    per_count = counts.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_values"))
    ranked = Window.orderBy(F.desc("n_items")).rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("n_values") * F.col("n_items")
    return per_count.select(
        "n_items",
        "n_values",
        F.sum("n_values").over(ranked).alias("cum_values"),
        F.sum(held).over(ranked).alias("cum_items"),
    )


def concentration_curve(df: DataFrame, by: str | Iterable[str]) -> DataFrame:
    """For each number of items a value of ``by`` can have: the values with that
    many, and values and items down to it, counted from the largest."""
    by = as_list(by)
    reject_clash(by, ["n_items", "n_values", "cum_values", "cum_items"])
    return _curve(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items")))


def concentration(df: DataFrame, by: str | Iterable[str]) -> DataFrame:
    """Values of ``by`` with their items, rank and the items down to that rank.

    Values with equally many items share a rank (1, 2, 2, 4, ...) and a
    cumulative count that includes them all. Both then depend on the count
    alone: they are worked out on the curve and joined back, and the values
    themselves are never sorted. The curve's length is bounded as said above,
    so it is broadcast: its join keys are as skewed as they come.
    """
    by = as_list(by)
    reject_clash(by, ["n_items", "rank", "cum_items"])
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"))
    curve = _curve(counts).select(
        F.col("n_items").alias("_n"),
        (F.col("cum_values") - F.col("n_values") + 1).alias("rank"),
        "cum_items",
    )
    return counts.join(F.broadcast(curve), counts["n_items"] == curve["_n"]).select(
        *by, "n_items", "rank", "cum_items"
    )
