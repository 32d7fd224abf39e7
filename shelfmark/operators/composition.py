"""What is a collection made of?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import as_list, null_safe, reject_clash


def composition(
    df: DataFrame, by: str | Iterable[str], measure: str | None = None
) -> DataFrame:
    """Items (and the total of ``measure``) for every subset of ``by``.

    ``subtotal`` tells a subtotal from a group whose attribute is null: reading
    ``by`` from left to right, its bits are 1 where the attribute is summed over.

    The items are counted at the finest grain first, so that the cube expands
    the groups and not the rows. An empty table has no groups and gives no
    rows, not even a total.
    """
    by = as_list(by)
    reject_clash(by, ["n_items", "total", "subtotal"])
    fine = [F.count(F.lit(1)).alias("n_items")]
    coarse = [
        F.grouping_id().cast("bigint").alias("subtotal"),
        F.sum("n_items").alias("n_items"),
    ]
    if measure is not None:
        fine.append(F.sum(measure).alias("total"))
        coarse.append(F.sum("total").alias("total"))
    return df.groupBy(*by).agg(*fine).cube(*by).agg(*coarse)


def share(df: DataFrame, by: str | Iterable[str], parent: str | Iterable[str]) -> DataFrame:
    """Items per group and their share of the enclosing ``parent`` group.

    ``parent`` names some of ``by``. The totals per parent are joined back
    rather than taken over a window: a window would sort all groups of one
    parent in one task. The groups' shuffle is computed once for both sides.
    """
    by, parent = as_list(by), as_list(parent)
    reject_clash(by, ["n_items", "parent_items", "share"])
    if not set(parent) < set(by):
        raise ValueError(f"parent {parent} must name some, not all, of {by}")
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"))
    named = [F.col(c).alias(f"_parent_{c}") for c in parent]
    parents = groups.groupBy(*named).agg(F.sum("n_items").alias("parent_items"))
    same = null_safe(groups, parents, [(c, f"_parent_{c}") for c in parent])
    return groups.join(parents, same).select(
        *by,
        "n_items",
        "parent_items",
        (F.col("n_items") / F.col("parent_items")).alias("share"),
    )
