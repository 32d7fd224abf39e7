"""Benchmark passages in documents, by a prefix-filtered containment join.

A benchmark item is its windows of 13 words, a shorter item its one window of
all its words. A document holds a window when all the window's words stand in
it in order, so it holds the window's rarest word: the necessary prefix of an
exact containment is that one word, rarity being counted over all documents.
Documents give the places of such words with the words around them; these meet
the windows on the word, the window's position and length must fit into the
document, and then the words are compared one by one.

What is broadcast are two tables of one flag per word slot, of a fixed size
whatever the benchmark's. Words that share a slot only make more candidates.

Defined results: a null text has no words, and an item without words no window;
repeated documents are judged one by one; repeated items all count, a null
``item_id`` is left out of the list of items but counted; empty tables on
either side give whole results without hits. Other columns are carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.staging import staged

WORDS = 13
SHARE = 20  # contaminated from one word in so many
SLOTS = 1 << 22
ROWS = 500  # documents whose places are held at once

# a-z, 0-9 and all bytes beyond ASCII are of words; A-Z are lower-cased
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def slot(word: bytes) -> int:
    return zlib.crc32(word) & (SLOTS - 1)


def item_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """``item``, ``window`` (its words joined by blanks) of every item's windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column(1)):
                words = words_of(value.as_py())
                if words:
                    own = {
                        b" ".join(words[k : k + size])
                        for k in range(max(1, len(words) - size + 1))
                    }
                    rows += [row] * len(own)
                    found += sorted(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([w.decode() for w in found], pa.string()),
                ],
                names=["item", "window"],
            )

    schema = T.StructType([T.StructField("item", benchmark.schema[item].dataType)])
    return benchmark.select(item, text).mapInArrow(windows, schema.add("window", "string"))


def word_slots(words: DataFrame) -> DataFrame:
    """``slot`` of each ``word``, as ``slot`` above."""
    return words.withColumn(
        "slot", F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit(SLOTS - 1))
    )


def flagged_slots(slots: DataFrame) -> bytes:
    """One byte per slot, set for those in ``slots``: ``SLOTS`` bytes in all."""
    flags = bytearray(SLOTS)
    for row in slots.select("slot").distinct().toLocalIterator():
        flags[row[0]] = 1
    return bytes(flags)


def slot_counts(docs: DataFrame, text: str, flags) -> DataFrame:
    """Documents per flagged slot, over all documents."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        flag = flags.value
        for batch in batches:
            for value in batch.column(0):
                for s in {zlib.crc32(w) & (SLOTS - 1) for w in set(words_of(value.as_py()))}:
                    if flag[s]:
                        total[s] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(total[found])], names=["slot", "n"]
        )

    return (
        docs.select(text)
        .mapInArrow(counts, "slot bigint, n bigint")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
    )


def prefixed(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """Each window with its rarest word, that word's place, and its words."""
    words = F.posexplode(F.split("window", " ")).alias("at", "word")
    placed = word_slots(windows.select("window", words))
    ranked = placed.join(rarity, "slot", "left").select(
        "window", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at").alias("w")
    )
    return (
        ranked.groupBy("window")
        .agg(F.min("w").alias("w"))
        .select(
            "window",
            F.col("w.word").alias("word"),
            F.col("w.at").alias("at"),
            F.size(F.split("window", " ")).alias("size"),
        )
    )


def candidates(docs: DataFrame, text: str, flags, size: int) -> DataFrame:
    """``docs`` without the text but with ``n_words`` and the ``places`` of
    flagged words: position, word, the words around, and how many are before."""
    kept = [c for c in docs.columns if c != text]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag, crc, mask = flags.value, zlib.crc32, SLOTS - 1
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            numbers, found = [], []
            for value in batch.column(len(kept)):
                words = words_of(value.as_py())
                own = []
                for i in [i for i, w in enumerate(words) if flag[crc(w) & mask]]:
                    low = max(0, i - size + 1)
                    around = b" ".join(words[low : i + size]).decode()
                    own.append((i, words[i].decode(), around, i - low))
                numbers.append(len(words))
                found.append(own)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            flat = [p for f in found for p in f]
            at, word, around, before = zip(*flat) if flat else ((), (), (), ())
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(at, pa.int64()),
                    pa.array(word, pa.string()),
                    pa.array(around, pa.string()),
                    pa.array(before, pa.int64()),
                ],
                names=["at", "word", "around", "before"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(kept))),
                    pa.array(numbers, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                ],
                names=[*kept, "n_words", "places"],
            )

    place = T.StructType().add("at", "long").add("word", "string")
    place = place.add("around", "string").add("before", "long")
    schema = T.StructType([docs.schema[c] for c in kept])
    schema = schema.add("n_words", "long").add("places", T.ArrayType(place))
    return docs.select(*kept, text).mapInArrow(places, schema)


def hits(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """``uid``, ``start``, ``size``, ``window`` of every window a document holds."""
    at = placed.select("uid", "n_words", F.explode("places").alias("p")).select(
        "uid", "n_words", "p.*"
    )
    joined = at.withColumnRenamed("at", "place").join(windows, "word")
    start = F.col("place") - F.col("at")
    fits = (F.col("before") >= F.col("at")) & (start + F.col("size") <= F.col("n_words"))
    around = F.split("around", " ")
    found = F.slice(around, (F.col("before") - F.col("at") + 1).cast("int"), F.col("size"))
    return (
        joined.where(fits)
        .where(F.array_join(found, " ") == F.col("window"))
        .select("uid", start.alias("start"), "size", "window")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WORDS,
    share: int = SHARE,
) -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_words``, ``n_hit``,
    ``n_items``, ``items_sha256`` and ``contaminated``.

    Texts are read twice and never shuffled. A column of ``docs`` with the name
    of a result gives way to it.
    """
    results = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    carried = [c for c in docs.columns if c != text and c.lower() not in results]
    names = [f"_c{i}" for i in range(len(carried))]
    docs = docs.select(
        *[F.col(c).alias(name) for c, name in zip(carried, names)], F.col(text).alias("text")
    )
    text = "text"
    context = docs.sparkSession.sparkContext
    items = staged(item_windows(benchmark, item, item_text, size), "items")
    windows = items.select("window").distinct()
    words = word_slots(windows.select(F.explode(F.split("window", " ")).alias("word")))
    rarity = slot_counts(docs, text, context.broadcast(flagged_slots(words)))
    windows = staged(prefixed(windows, rarity), "windows")
    flags = context.broadcast(flagged_slots(word_slots(windows)))
    placed = staged(
        candidates(docs, text, flags, size).withColumn("uid", F.monotonically_increasing_id()),
        "places",
    )
    found = staged(hits(placed, windows), "hits")

    # words under overlapping windows count once
    before = Window.partitionBy("uid").orderBy("start", "size")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    covered = (
        found.select("uid", "start", "size")
        .distinct()
        .withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("uid")
        .agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    )
    named = F.array_sort(F.collect_list(F.col("item").cast("string")))
    held = (
        found.select("uid", "window")
        .distinct()
        .join(items, "window")
        .select("uid", "item")
        .distinct()
        .groupBy("uid")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        )
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return (
        placed.drop("places")
        .join(covered, "uid", "left")
        .join(held, "uid", "left")
        .select(
            *[F.col(name).alias(c) for c, name in zip(carried, names)],
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )
