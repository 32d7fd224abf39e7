"""What do the parts of a collection have in common?

A null part is a part like others. An item whose content is unknown (null)
counts as an item, and is neither distinct nor shared nor anyone's alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.content import content_keys, key_names, known


def content_index(df: DataFrame, part: str, content: str | Iterable[str]) -> DataFrame:
    """One row per part and content it holds, with the number of copies.

    All items of a part with unknown content are one row whose keys are null.
    """
    keys = content_keys(df, content, where=known(content))
    return df.groupBy(F.col(part).alias("part"), *keys).agg(F.count(F.lit(1)).alias("copies"))


def _known(index: DataFrame) -> Column:
    """Whether a row of the index, or of its contents, is of a known content.

    It looks at ``copies``, an aggregate, so that it stays above the
    aggregation: pushed into the scan it would make it a second scan instead of
    a reuse of the index's shuffle.
    """
    result = F.lit(True)
    for key in key_names(index.columns):
        result = result & F.when(F.col("copies") > 0, F.col(key)).isNotNull()
    return result


def overlap_with(
    df: DataFrame, part: str, content: str | Iterable[str], anchors: Iterable | DataFrame
) -> DataFrame:
    """Contents that each part shares with each of the ``anchors``.

    One row per anchor and other part with something in common. Copies are
    folded before the join, and only the anchors' holdings are on its other
    side: the rows it makes are the holdings times the anchors at most. Pairs
    of parts the caller did not ask for are never formed, but with every part
    as an anchor all pairs are asked for. None is the null part. Many anchors are
    better given as a DataFrame, whose first column names them.
    """
    return shared_with(content_index(df, part, content), anchors)


def _holdings_of(index: DataFrame, anchors: Iterable | DataFrame, stored: bool) -> DataFrame:
    if isinstance(anchors, DataFrame):
        named = anchors.select(F.col(anchors.columns[0]).alias("_named"))
        return index.join(named, F.col("part").eqNullSafe(F.col("_named")), "left_semi")
    anchors = list(anchors)
    there = F.col("part") if stored else F.when(F.col("copies") > 0, F.col("part"))
    asked = there.isin([a for a in anchors if a is not None])
    if None in anchors:
        asked = F.coalesce(asked, F.lit(True)) if stored else asked | there.isNull()
    return index.where(asked)


def shared_with(
    index: DataFrame, anchors: Iterable | DataFrame, stored: bool = False
) -> DataFrame:
    """``overlap_with`` on an index already made.

    On a ``stored`` index the anchors are looked up in the files; otherwise
    their filter stays above the aggregation, for the reason told in ``_known``.
    """
    keys = key_names(index.columns)
    if stored:
        contents = F.lit(True)
        for key in keys:
            contents = contents & F.col(key).isNotNull()
    else:
        contents = _known(index)
    held = _holdings_of(index.where(contents), anchors, stored)
    anchored = held.select(F.col("part").alias("anchor"), *keys)
    return (
        index.where(contents)
        .select("part", *keys)
        .join(anchored, keys)
        .where(~F.col("part").eqNullSafe(F.col("anchor")))
        .groupBy("anchor", F.col("part").alias("other"))
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )


def overlap_depth(df: DataFrame, part: str, content: str | Iterable[str]) -> DataFrame:
    """How many contents are held by exactly one part, by two, by three, ..."""
    return depth(content_index(df, part, content))


def depth(index: DataFrame) -> DataFrame:
    """``overlap_depth`` on an index already made."""
    per_content = index.groupBy(*key_names(index.columns)).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("copies").alias("copies")
    )
    return (
        per_content.where(_known(per_content))
        .groupBy("n_parts")
        .agg(F.count(F.lit(1)).alias("n_contents"), F.sum("copies").alias("n_items"))
    )


def overlap_summary(df: DataFrame, part: str, content: str | Iterable[str]) -> DataFrame:
    """Per part: items and distinct contents, and of these the ones no other
    part holds (``n_sole``, with ``sole_items`` copies) and the ones shared."""
    return summary(content_index(df, part, content))


def _part_pieces() -> list[Column]:
    """128 bits that tell a part from any other, in numbers."""
    return [F.xxhash64("part").alias("_p1"), F.xxhash64(F.lit(1), "part").alias("_p2")]


def summary(index: DataFrame) -> DataFrame:
    """``overlap_summary`` on an index already made.

    A content with one holder names that holder by the minima of the pieces of
    its digest, which are numbers, so that parts of any type are aggregated in
    hash tables; holders are not listed.
    """
    held = index.groupBy("part").agg(
        F.sum("copies").alias("n_items"),
        F.count(F.when(_known(index), 1)).alias("n_distinct"),
    )
    contents = (
        index.select(*key_names(index.columns), "copies", *_part_pieces())
        .groupBy(*key_names(index.columns))
        .agg(
            F.count(F.lit(1)).alias("holders"),
            F.min("_p1").alias("_s1"),
            F.min("_p2").alias("_s2"),
            F.sum("copies").alias("copies"),
        )
    )
    sole = (
        contents.where((F.col("holders") == 1) & _known(contents))
        .groupBy("_s1", "_s2")
        .agg(F.count(F.lit(1)).alias("n_sole"), F.sum("copies").alias("sole_items"))
    )
    n_sole, sole_items = (
        F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_sole", "sole_items")
    )
    named = held.select("*", *_part_pieces())
    same = (F.col("_p1") == F.col("_s1")) & (F.col("_p2") == F.col("_s2"))
    return named.join(sole, same, "left").select(
        "part",
        "n_items",
        "n_distinct",
        n_sole.alias("n_sole"),
        sole_items.alias("sole_items"),
        (F.col("n_distinct") - n_sole).alias("n_shared"),
    )
