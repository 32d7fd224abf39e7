"""Lines that many documents hold, dropped from all but one of them.

A line's key is the line without blanks at its ends, A-Z lower-cased, and enters
as two 64-bit hashes. Keys of enough characters in enough documents are shared;
their occurrences are dealt by ranges of the hashes and sorted by document and
position inside, and one pass over each range finds the first occurrences, the
largest document coming first. What comes back per document is no text but a
bitmap of the lines to keep, of which only the words are stored in which a line
is dropped. ``kept_text`` applies it.

How many documents hold a key is counted first, one row per key and task, so
only shared lines are sorted, and a key's number of occurrences is known before
they move: a key with more than ``BLOCK`` is dealt in that many blocks by
document, each of which finds its own first, and the firsts are put together.

Built-in functions only. Texts are read where they are; the bitmaps meet them in
one join, in which the texts move if the bitmaps are too large to be broadcast.

Defined results: a null or empty text is one empty line; every row is a document
of its own, repeated rows too, but all rows of the largest ``doc_id`` keep their
lines; a null ``doc_id`` comes before all others; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.names import null_safe
from shelfmark.llm.rows import with_row_keys
from shelfmark.llm.staging import staged

# fixed values of the contract
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 40
LEAST_DOCS = 5

BLOCK = 2048  # documents of a shared key that are streamed together
WORD = 64  # lines of a word of a bitmap

ROW = ["file", "place"]
HASHES = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def hashes(key: Column) -> list[Column]:
    """128 bits that tell a key from any other."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_keys(texts: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``h1``, ``h2`` and ``n``, the documents that hold the key."""
    keys = F.filter(
        F.transform(lines_of(folded(F.col("text"))), key_of),
        lambda key: F.char_length(key) >= least_chars,
    )
    return (
        texts.select(F.explode(F.array_distinct(keys)).alias("key"))
        .select(*hashes(F.col("key")))
        .groupBy(*HASHES)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_docs)
    )


def occurrences(texts: DataFrame, shared: DataFrame, least_chars: int, block: int) -> DataFrame:
    """The places of shared keys: hashes, block, document, row, line."""
    placed = texts.select("id", *ROW, F.posexplode(lines_of(folded(F.col("text")))).alias("at", "line"))
    placed = placed.select("id", *ROW, "at", key_of(F.col("line")).alias("key"))
    placed = placed.where(F.char_length("key") >= least_chars).select(
        "id", *ROW, "at", *hashes(F.col("key"))
    )
    known = shared.toDF("k1", "k2", "n")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("bigint")
    # a key that a third of all documents hold is skewed: the join is in the form that is split
    return placed.join(known, null_safe(placed, known, [("h1", "k1"), ("h2", "k2")])).select(
        *HASHES, F.pmod(F.xxhash64(*ROW), blocks).alias("block"), "id", *ROW, "at"
    )


def dropped_lines(placed: DataFrame) -> DataFrame:
    """Of the places of shared keys those that are not of the first document."""
    group = [*HASHES, "block"]
    dealt = placed.repartitionByRange(*group)
    stream = Window.partitionBy(*group).orderBy(F.desc_nulls_last("id"), *ROW, "at")
    first = F.first("id").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.row_number().over(stream) == 1
    streamed = staged(dealt.select("*", first.alias("first"), begins.alias("begins")), "ranges")
    # keys in several blocks: the first of the blocks' firsts, one row per block
    firsts = (
        streamed.where("begins")
        .groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
        .agg(F.max("first").alias("overall"), F.count(F.lit(1)).alias("blocks"))
        .where("blocks > 1")
    )
    joined = streamed.join(
        firsts, null_safe(streamed, firsts, [("h1", "k1"), ("h2", "k2")]), "left"
    )
    return joined.where(
        ~F.col("id").eqNullSafe(F.when(F.col("blocks") > 1, F.col("overall")).otherwise(F.col("first")))
    ).select(*ROW, "at")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """Per row: ``n_dropped`` and ``words``, the words of its keep bitmap in which
    a line is dropped, in order; bit k of word w is set where line ``64 w + k`` stays."""
    bit = F.expr(f"shiftleft(1L, at % {WORD})")
    return (
        dropped.groupBy(*ROW, F.expr(f"at div {WORD}").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy(*ROW)
        .agg(
            F.sum(F.bit_count("bits")).alias("n_dropped"),
            F.array_sort(
                F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))
            ).alias("words"),
        )
    )


def keep_bitmaps(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` as ``id``, ``text`` and the row's ``file`` and ``place``; and per
    row of which lines are dropped its ``file``, ``place``, ``n_dropped`` and ``words``."""
    keyed, keys = with_row_keys(docs)
    texts = keyed.select(
        F.col(id).alias("id"),
        F.col(text).alias("text"),
        *[F.col(k).alias(name) for k, name in zip(keys, ROW)],
    )
    shared = staged(shared_keys(texts, least_chars, least_docs), "shared")
    placed = staged(occurrences(texts, shared, least_chars, block), "places")
    return texts, bitmaps(dropped_lines(placed))


def kept_text(text: Column, words: Column) -> Column:
    """The lines that a bitmap keeps, joined: the runs between dropped lines."""
    lines = lines_of(text)
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    dropped = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.filter(bits, lambda b: F.getbit(w["keep"], b) == 0),
                lambda b: w["word"] * F.lit(WORD) + b,
            ),
        )
    )
    borders = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    runs = F.zip_with(
        F.slice(borders, F.lit(1), F.size(borders) - 1),
        F.slice(borders, F.lit(2), F.size(borders) - 1),
        lambda a, b: F.slice(lines, a + 2, b - a - 1),
    )
    return F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.flatten(runs), "\n")
    )


def without_shared_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", **rule: int
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_lines`` before, ``n_dropped``, and the
    ``text`` that stays."""
    texts, found = keep_bitmaps(docs, id, text, **rule)
    found = found.toDF("_file", "_place", "n_dropped", "words")
    same = null_safe(texts, found, [("file", "_file"), ("place", "_place")])
    return texts.join(found, same, "left").select(
        F.col("id").alias(id),
        F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        kept_text(F.col("text"), F.col("words")).alias("text"),
    )
