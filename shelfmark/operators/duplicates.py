"""Which contents does a collection hold more than once?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.content import content_keys, known, labelled


def exact_duplicates(df: DataFrame, content: str | Iterable[str], id: str) -> DataFrame:
    """One row per repeated content: its copies and the lowest id among them.

    A text appears as its digest, ``<column>_sha256``; ``first_id`` leads back
    to it. Items of unknown (null) content are copies of nothing. Copies are
    counted before the shuffle, so one content held by a third of all items
    costs each task one row.
    """
    repeated = (
        df.where(known(content))
        .groupBy(*content_keys(df, content))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(id).alias("first_id"))
        .where("copies > 1")
    )
    return labelled(repeated)
