"""How many items arrive when?"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from shelfmark.functions.names import as_list, reject_clash
from shelfmark.functions.periods import as_instant, as_zoneless


def _per_window(df: DataFrame, time: str, width: str, by: list[str]) -> DataFrame:
    window = F.window(time, width)
    return (
        df.groupBy(window.alias("_window"), *by)
        .agg(F.count(F.lit(1)).alias("n_items"))
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            *by,
            "n_items",
        )
    )


def arrivals(
    df: DataFrame,
    time: str,
    width: str,
    lateness: str | None = None,
    by: str | Iterable[str] = (),
) -> DataFrame:
    """Items per window of ``width`` on ``time``, for a table or a stream.

    On a stream, ``lateness`` sets the watermark: in append mode a window
    comes out once nothing that late can still reach it, and later items are
    left out. ``append_arrivals`` leaves no item out and holds none back.
    """
    by = as_list(by)
    reject_clash(by, ["window_start", "window_end", "n_items"])
    if lateness is None:
        return _per_window(df, time, width, by)
    zoneless = isinstance(df.schema[time].dataType, TimestampNTZType)
    if zoneless:  # which a watermark does not take
        df = df.withColumn(time, as_instant(F.col(time)))
    counts = _per_window(df.withWatermark(time, lateness), time, width, by)
    if zoneless:
        for bound in ("window_start", "window_end"):
            counts = counts.withColumn(bound, as_zoneless(F.col(bound)))
    return counts


def _commit(counts: DataFrame, path: str, first: int, last: int) -> None:
    """Write ``counts`` to a folder of its own and then one row that says so.

    The row is one file, so a reader sees all of the counts or none. What was
    written without its row, by a batch that died, is never read.
    """
    attempt = uuid.uuid4().hex
    counts.write.parquet(f"{path}/counts/{attempt}")
    row = counts.sparkSession.range(1).select(
        F.lit(first).cast("bigint").alias("first"),
        F.lit(last).cast("bigint").alias("last"),
        F.lit(attempt).alias("attempt"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _committed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last batch committed and the folders that hold each batch once.

    These are the widest compaction and every batch after it. A batch that ran
    twice wrote the same counts twice, of which one is taken. Rows of later
    batches than the compaction come to the driver, one each.
    """
    commits = spark.read.parquet(f"{path}/commits")
    compacted = F.coalesce(
        F.max(F.when(F.col("first") < F.col("last"), F.col("last"))), F.lit(-1)
    )
    reached = commits.agg(compacted).first()[0]
    later = F.when(F.col("last") > reached, F.col("first") == F.col("last")).otherwise(
        (F.col("last") == reached) & ((F.col("first") < F.col("last")) | (reached < 0))
    )
    rows = commits.where(later).groupBy("last").agg(F.min("attempt").alias("attempt")).collect()
    return max(r["last"] for r in rows), [f"{path}/counts/{r['attempt']}" for r in rows]


def append_arrivals(
    stream: DataFrame,
    time: str,
    width: str,
    path: str,
    checkpoint: str,
    by: str | Iterable[str] = (),
) -> StreamingQuery:
    """Start writing the arrivals of each batch of ``stream`` to a table at ``path``.

    Each batch adds its own counts under its number and commits them at once;
    readers add them up with ``read_arrivals``. There is no state between
    batches, late items count like others, and a batch run again counts once.
    A ``path`` belongs to one ``checkpoint``. Takes all that is there, then stops.
    """
    by = as_list(by)
    reject_clash(by, ["window_start", "window_end", "n_items", "batch"])
    # a table without a batch is empty, not missing
    empty = stream.sparkSession.createDataFrame([], _per_window(stream, time, width, by).schema)
    _commit(empty, path, -1, -1)

    def write(batch: DataFrame, number: int) -> None:
        _commit(_per_window(batch, time, width, by), path, number, number)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_arrivals(spark: SparkSession, path: str, by: str | Iterable[str] = ()) -> DataFrame:
    """Arrivals per window over all batches committed to ``path`` so far.

    A batch that is being written, or written again, is seen as a whole or not
    at all. Only the folders that count are listed.
    """
    by = as_list(by)
    _, folders = _committed(spark, path)
    return (
        spark.read.parquet(*folders)
        .groupBy("window_start", "window_end", *by)
        .agg(F.sum("n_items").alias("n_items"))
    )


def compact_arrivals(spark: SparkSession, path: str, by: str | Iterable[str] = ()) -> None:
    """Add up all batches committed to ``path`` so far in one folder.

    Later readers take that folder and the batches after it. It may run again,
    beside a stream or after having died half-way, and changes no total. The
    batches' own folders stay for readers that are under way.
    """
    by = as_list(by)
    last, folders = _committed(spark, path)
    if len(folders) > 1:
        counts = spark.read.parquet(*folders).groupBy("window_start", "window_end", *by)
        _commit(counts.agg(F.sum("n_items").alias("n_items")), path, -1, last)
