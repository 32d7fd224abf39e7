"""Several reports from one reading of a collection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.content import key_names, labelled
from shelfmark.operators import overlap
from shelfmark.sources.shared import shared_folder


class Holdings:
    """A collection's index of (part, content) with its copies, written once.

    The reports below then read the index, some 50 bytes per part and content,
    and not the collection's texts. It is not bucketed by content: a content
    that very many parts hold would make one bucket, and its task, very large.
    """

    def __init__(self, index: DataFrame):
        self.index = index

    @classmethod
    def write(
        cls, df: DataFrame, part: str, content: str | Iterable[str], path: str | None = None
    ) -> Holdings:
        """Index ``df`` at ``path``, or in a new folder that all executors share."""
        path = path or shared_folder(df.sparkSession, "holdings")
        overlap.content_index(df, part, content).sortWithinPartitions("part").write.parquet(path)
        return cls.open(df.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Holdings:
        """The index written at ``path`` before."""
        index = spark.read.parquet(path)
        if not {"part", "copies"} < set(index.columns) or not key_names(index.columns):
            raise ValueError(f"{path} is no index of holdings: it has {index.columns}")
        return cls(index)

    def summary(self) -> DataFrame:
        """See ``overlap_summary``."""
        return overlap.summary(self.index)

    def depth(self) -> DataFrame:
        """See ``overlap_depth``."""
        return overlap.depth(self.index)

    def shared_with(self, anchors: Iterable | DataFrame) -> DataFrame:
        """See ``overlap_with``."""
        return overlap.shared_with(self.index, anchors, stored=True)

    def copies(self) -> DataFrame:
        """Contents held more than once, with their copies and holders."""
        repeated = (
            self.index.groupBy(*key_names(self.index.columns))
            .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n_parts"))
            .where("copies > 1")
        )
        for key in key_names(self.index.columns):  # unknown contents are copies of nothing
            repeated = repeated.where(F.col(key).isNotNull())
        return labelled(repeated)
