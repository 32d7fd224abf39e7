"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.sources.shared import shared_folder


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder, read back from there.

    A lost executor costs the tasks it ran and never what was written; later
    readers start from the table and do not repeat the work before it.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
