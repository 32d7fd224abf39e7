"""Reading the tables of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``: one file, or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files, in its own schema."""
    schema = table(spark, folder, name).schema
    # a stream takes a single file only by pattern; this one matches just the name
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")
