"""Names for the rows of a table, and taking rows out of it by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.names import null_safe
from shelfmark.llm.staging import staged

# rows whose keys (16 bytes each) are broadcast
MOST_BROADCAST = 1 << 20
# bits of the filter that is broadcast beyond that: 32 MB
FILTER_BITS = 1 << 28


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that tell each row from any other, and their names.

    A row is known by its file and its place in it, which stay the same however
    often the table is read. What is not read from files is written first.
    """
    file, place = free_name(df, "_row_file"), free_name(df, "_row_place")

    def keyed(df: DataFrame) -> DataFrame:
        hidden = df.metadataColumn("_metadata")
        return df.withColumns(
            {file: F.xxhash64(hidden["file_path"]), place: hidden["row_index"]}
        )

    try:
        return keyed(df), [file, place]
    except AnalysisException:
        return keyed(staged(df, "rows")), [file, place]


def flagged(keys: DataFrame, names: list[str]) -> bytes:
    """A filter of ``FILTER_BITS`` bits, in which the bits of the rows of ``keys`` are set."""
    slot = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    words = keys.groupBy((slot.bitwiseAND(F.lit(~63))).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(names)}), 64) as int))")).alias("bits")
    )
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        filled[row["at"] // 64] = row["bits"]
    return filled.tobytes()


def surviving(keyed: DataFrame, keys: list[str], decided: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that ``decided`` (``keys`` and ``kept``, a table with a
    row for each) keeps, without their keys.

    Rows stay where they are read. The keys of the kept or of the others,
    whichever are fewer, are broadcast while they are few. Beyond that a filter
    of fixed size is: rows it does not know stay as they are, and only those
    that it may know, the rejected ones and some more, meet the keys in a join.
    """
    plain = [c for c in keyed.columns if c not in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    table = decided.toDF(*names, "kept")
    n_kept, n = table.agg(F.count_if("kept"), F.count(F.lit(1))).first()
    same = null_safe(keyed, table, zip(keys, names))
    if min(n_kept, n - n_kept) <= MOST_BROADCAST:
        fewer, how = ("kept", "left_semi") if 2 * n_kept < n else ("not kept", "left_anti")
        return keyed.join(F.broadcast(table.where(fewer).select(names)), same, how).select(plain)
    rejected = table.where("not kept").select(names)
    bits = keyed.sparkSession.sparkContext.broadcast(flagged(rejected, names))

    @F.arrow_udf(T.BooleanType())
    def perhaps(hashes: pa.Array) -> pa.Array:
        words = np.frombuffer(bits.value, np.int64)
        slots = hashes.to_numpy() % FILTER_BITS
        return pa.array((words[slots // 64] >> (slots % 64)) & 1 == 1)

    doubtful = perhaps(F.xxhash64(*keys))
    settled = keyed.where(doubtful).join(rejected, same, "left_anti")
    return keyed.where(~doubtful).union(settled).select(plain)
