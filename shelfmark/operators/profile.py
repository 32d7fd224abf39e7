"""How large is each part of a collection, and how much of it is distinct?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.content import content_keys
from shelfmark.functions.names import as_list, reject_clash


def profile(
    df: DataFrame,
    by: str | Iterable[str],
    content: str | Iterable[str],
    measure: str | None = None,
) -> DataFrame:
    """Items, distinct known contents and, with ``measure``, its total per group.

    Spark plans the one distinct count as an aggregation per group and content
    key, then one per group, each combined before its shuffle: neither a large
    group nor a much-copied content lands on one task.
    """
    by = as_list(by)
    reject_clash(by, ["n_items", "n_distinct", "total"])
    aggs = [
        F.count(F.lit(1)).alias("n_items"),
        F.count_distinct(*content_keys(df, content)).alias("n_distinct"),
    ]
    if measure is not None:
        aggs.append(F.sum(measure).alias("total"))
    return df.groupBy(*by).agg(*aggs)
