"""How does a collection grow?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.names import as_list, null_safe, reject_clash
from shelfmark.functions.periods import ENCLOSING, SHORT, period


def growth(
    df: DataFrame, time: str, unit: str, by: str | Iterable[str] = ()
) -> DataFrame:
    """Items per period with the running total, overall or per group.

    Items without a time are left out. For days and longer periods one window
    per group sorts under 37,000 rows a century. For shorter ones the running
    total is taken within each enclosing period (the seconds of a day, say) and
    then across those, so a window sorts at most 86,400 rows, or one per
    enclosing period.
    """
    by = as_list(by)
    reject_clash(by, ["period", "n_items", "total_items"])
    counts = (
        df.where(F.col(time).isNotNull())
        .groupBy(*by, period(df, time, unit).alias("period"))
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
    before = Window.unboundedPreceding
    if unit not in SHORT:
        running = Window.partitionBy(*by).orderBy("period").rowsBetween(before, 0)
        return counts.withColumn("total_items", F.sum("n_items").over(running))

    counts = counts.withColumn("_span", period(counts, "period", ENCLOSING[unit]))
    spans = counts.groupBy(*by, "_span").agg(F.sum("n_items").alias("_in_span"))
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(before, -1)
    spans = spans.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_span").alias("_from"),
        F.coalesce(F.sum("_in_span").over(earlier), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*by, "_span").orderBy("period").rowsBetween(before, 0)
    counts = counts.withColumn("_within", F.sum("n_items").over(within))
    # plain equality would filter one side for nulls and so scan the table twice
    pairs = [("_span", "_from"), *((c, f"_by_{c}") for c in by)]
    same = null_safe(counts, spans, pairs)
    return counts.join(spans, same).select(
        *by, "period", "n_items", (F.col("_before") + F.col("_within")).alias("total_items")
    )
