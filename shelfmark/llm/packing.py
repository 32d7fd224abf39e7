"""Packing of documents into sequences of a fixed number of tokens.

Every document becomes its token ids and a separator. Longer ones than a
sequence are cut into full pieces, the first taking what is left over. The
pieces are dealt over partitions, and each partition is packed by best-fit
decreasing. Dual feasible functions give a lower bound on the sequences a
partition's pieces need; where best fit reaches it the partition is certified.
Partitions with a gap exchange the pieces of their sequences that are not full
(certified ones only those of their emptiest sequence), and those are packed
anew, for as long as that saves sequences. Each piece says whether the partition
it was packed in is certified; ``certificate`` holds all of a packing against the
bound of all its pieces.

Defined results: a null text is empty and leaves its separator; repeated rows
are packed each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.staging import staged
from shelfmark.llm.tokens import KEPT_WORDS, WIDTH, encoder

SIZE = 2048
SEPARATOR = 0
PIECES_PER_PART = 2500


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    if length <= size:
        return [(0, length)]
    first = length % size or size
    return [(0, first), *((s, size) for s in range(first, length, size))]


def token_pieces(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    separator: int = SEPARATOR,
    vocabulary: str | None = None,
    special: bool = True,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """Per piece: the document's id, ``piece``, ``start``, ``length`` and the
    CRC-32 of its ids. ``special``: strings of special tokens are those tokens.
    ``kept_words``: words that a worker keeps the ids of, for speed alone."""
    end = np.array([separator], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special, kept_words).text
        for batch in batches:
            rows = []
            for row, value in enumerate(batch.column(1)):
                ids = memoryview(encode(value.as_py() or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // WIDTH, size)):
                    part = ids[start * WIDTH : (start + length) * WIDTH]
                    rows.append((row, k, start, length, zlib.crc32(part)))
            if rows:
                row, piece, start, length, crc = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    fields = [T.StructField("id", docs.schema[id].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    return docs.select(id, text).mapInArrow(pieces, T.StructType(fields))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by best-fit decreasing."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r is set where a bin with room r is open
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = used, size
            used += 1
        bins[i], offsets[i] = b, size - room
        if room > need:
            open_bins[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that pieces of these lengths need at least."""
    return bound_of_counts(np.bincount(lengths, minlength=size + 1), size)


def bound_of_counts(count: np.ndarray, size: int) -> int:
    """The bound for ``count[n]`` pieces of each length ``n``, by two families of
    dual feasible functions.

    The first counts a piece over ``size - k`` as a whole sequence and drops
    those under ``k``; the second rounds lengths down to parts of a ``k``-th,
    as no more than ``k`` pieces over a ``k + 1``-th go together.
    """
    if not count.any():
        return 0
    value = np.arange(size + 1)
    total = np.concatenate([[0], np.cumsum(count * value)])  # of lengths below
    number = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(size // 2 + 1)
    whole = number[size + 1] - number[size - k + 1]
    between = total[size - k + 1] - total[k]
    best = int(np.max(-(-(whole * size + between) // size)))
    for k in range(2, 21):
        scaled = value * (k + 1)
        exact = scaled % size == 0
        # in units of 1 / (k * size)
        worth = np.where(exact, value * k, scaled // size * size)
        best = max(best, int(-(-(count * worth).sum() // (k * size))))
    return best


def certificate(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: ``n_sequences`` of a packing, and the ``lower_bound`` for its pieces.

    No more than a row per length comes to the driver.
    """
    count = np.zeros(size + 1, np.int64)
    for row in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        count[row["length"]] = row["n"]
    return packed.agg(F.count_distinct("sequence_id").alias("n_sequences")).withColumn(
        "lower_bound", F.lit(bound_of_counts(count, size)).cast("bigint")
    )


def _pack(size: int):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit(lengths, size)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) - lower_bound(lengths, size)
        again = fill < size if gap else np.arange(len(fill)) == np.argmin(fill)
        first = np.full(len(fill), -1, np.int64)
        first[bins[::-1]] = np.arange(len(bins))[::-1]  # a piece of each bin names it
        names = table["uid"].to_numpy()[first]
        return pa.table(
            {
                **{c: table[c] for c in table.column_names if c != "part"},
                "sequence_id": names[bins],
                "offset": offsets,
                "certified": np.full(len(bins), gap == 0),
                "again": again[bins] & (fill[bins] < size),
            }
        )

    return pack


def _packed(pieces: DataFrame, parts: int, turn: int, size: int) -> DataFrame:
    schema = T.StructType(pieces.schema.fields)
    for name, kind in (
        ("sequence_id", "long"), ("offset", "long"), ("certified", "boolean"), ("again", "boolean"),
    ):
        schema = schema.add(name, kind)
    part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts))
    return pieces.withColumn("part", part).groupBy("part").applyInArrow(_pack(size), schema)


def best_fit_packing(
    pieces: DataFrame,
    size: int = SIZE,
    per_part: int = PIECES_PER_PART,
) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` and ``certified``, whether the
    partition that it was packed in needs as many sequences as it got.

    Only numbers move: a piece is its length and what the caller wants back. A
    partition holds about ``per_part`` pieces, whatever the size of the table.
    """
    columns = pieces.columns
    pieces = staged(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    kept = columns + ["sequence_id", "offset", "certified"]
    own = F.col("uid").alias("sequence_id")
    start = F.lit(0).cast("bigint").alias("offset")
    done = [
        pieces.where(F.col("length") >= size).select(*columns, own, start, F.lit(True).alias("certified"))
    ]
    loose = pieces.where(F.col("length") < size)
    before = None
    for turn in count():
        n = loose.count()
        if not n:
            break
        packed = staged(_packed(loose.select(*columns, "uid"), -(-n // per_part), turn, size), "packed")
        after = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if before is not None and after >= before:
            break  # as they were packed before is as good
        if before is not None:
            done.pop()
        done.append(packed.where("not again").select(*kept))
        loose = packed.where("again")
        before = loose.agg(F.count_distinct("sequence_id")).first()[0]
        done.append(loose.select(*kept))
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result
