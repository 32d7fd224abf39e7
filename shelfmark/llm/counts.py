"""Token counts of documents from flat token files.

A flat token file is nothing but ids of a fixed width, documents ending with a
separator id; there is no index. Spark reads a file in byte ranges, many tasks
sharing it. A range does not know whether it starts within an id, so its bytes
are searched for the separator in every phase, all ids of a block at once. A
prefix scan over the ranges of each file then tells where they lie, which phase
holds, how many documents end before, and where the last of them ended: what
runs over a border is counted from there, also a separator cut by it.

Files that this module writes are named by the rows whose ids they hold, so
that counts can be given back to their documents.

Defined results: an empty document counts no ids; ids after the last separator
of a file are a document without end and count as one; a null text is written
as an empty document; no files, or empty ones, give no rows; a file that is not
a whole number of ids is refused. Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.rows import with_row_keys
from shelfmark.llm.staging import staged
from shelfmark.llm.tokens import encoder

WIDTH = 2  # bytes of an id in the files, little-endian and unsigned
SEPARATOR = 50256
BLOCK = 1 << 20  # ids that are searched at once, if a document has no more
DOCS_PER_FILE = 20_000
# the mark of UTF-8, which Spark's reader of texts skips at the start of a file
MARK = b"\xef\xbb\xbf"


def write_token_files(
    docs: DataFrame,
    path: str,
    text: str = "text",
    separator: int = SEPARATOR,
    vocabulary: str | None = None,
    docs_per_file: int = DOCS_PER_FILE,
    id: str = "doc_id",
    width: int = WIDTH,
) -> DataFrame:
    """Write the ids of all texts to flat files under ``path``, at most
    ``docs_per_file`` documents in each, and return an index of the rows for
    ``document_counts``.

    Spark's text writer makes them: it writes a value's bytes as they are, and
    the separator's bytes where lines would end. A file's folder names the file
    and the rows that its texts come from, whichever task wrote it.
    """
    keyed, (file, place) = with_row_keys(docs)
    chunk = F.floor(F.col(place) / docs_per_file)
    keyed = keyed.select(
        F.col(id).alias("id"),
        F.col(file).alias("file"),
        chunk.alias("chunk"),
        F.col(place).alias("place"),
        F.col(text).alias("text"),
    )

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special=False).text  # the separator's string is text
        chunk, first = None, 0
        for batch in batches:
            runs, found = [], []
            for f, c, p, value in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if (f, c) != chunk:
                    chunk, first = (f, c), p
                wide = np.frombuffer(encode(value.as_py() or ""), "<u4")
                if len(wide) and int(wide.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id does not fit into {width} bytes")
                runs.append(f"{f}_{c}_{first}")
                found.append(wide.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs, pa.string()), batch.column(2), pa.array(found, pa.binary())],
                names=["run", "place", "ids"],
            )

    (
        keyed.select("file", "chunk", "place", "text")
        .mapInArrow(ids, "run string, place bigint, ids binary")
        .sortWithinPartitions("run", "place")
        .select("run", F.col("ids").cast("string").alias("value"))
        .write.partitionBy("run")
        .option("lineSep", separator.to_bytes(width, "little").decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(path)
    )
    return keyed.drop("text")


def line_end(end: bytes) -> bytes:
    """The longest start of a separator that does not overlap itself. Spark's
    reader finds the same lines from every border only between such bytes."""
    return next(
        end[:n]
        for n in range(len(end), 0, -1)
        if not any(end[:k] == end[n - k : n] for k in range(1, n))
    )


def scan_ranges(files: DataFrame, end: bytes, block: int) -> DataFrame:
    """Of ``files`` (lines between the bytes ``line_end(end)``, with their ``path``,
    the ``range`` they were read in and the ``file_size``), places being those in
    the range, per phase of ids: every document between two separators of it (its
    ``k``, ``start`` and ``n_tokens``); and in a row without a phase what the scan
    over ranges needs."""
    width = len(end)
    separator, cut_at = int.from_bytes(end, "little"), line_end(end)
    phases = range(width)

    def documents(key, phase, numbers, start, length):
        n = len(start)
        path, begin, size = key
        return pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(path, pa.string()), n),
                pa.repeat(pa.scalar(begin, pa.int64()), n),
                pa.repeat(pa.scalar(size, pa.int64()), n),
                pa.repeat(pa.scalar(phase, pa.int32()), n),
                pa.array(numbers, pa.int64()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                *(pa.nulls(n, field.type) for field in state),
            ],
            names=names,
        )

    longs = pa.list_(pa.int64())
    state = [
        pa.field("size", pa.int64()), pa.field("head", pa.binary()), pa.field("tail", pa.binary()),
        pa.field("firsts", longs), pa.field("lasts", longs), pa.field("ends", longs),
    ]
    own = ["path", "range", "file_size", "phase", "k", "start", "n_tokens"]
    names = own + [field.name for field in state]

    class Range:
        """What is known of a range so far."""

        def __init__(self, key):
            self.key, self.size, self.head, self.tail = key, 0, b"", b""
            self.first, self.last, self.ends = [None] * width, [None] * width, [0] * width

        def search(self, data: bytes) -> Iterator[pa.RecordBatch]:
            """The documents between separators, of which the last is in ``data``."""
            buffer = self.tail + data
            base = self.size - len(self.tail)
            for phase in phases:
                skip = (phase - base) % width
                whole = (len(buffer) - skip) // width
                if whole <= 0:
                    continue
                ids = np.frombuffer(buffer, f"<u{width}", whole, skip)
                at = np.flatnonzero(ids == separator) * width + (skip + base)
                if not len(at):
                    continue
                n, last = self.ends[phase], self.last[phase]
                if last is None:
                    self.first[phase] = int(at[0])
                else:
                    at = np.concatenate([[last], at])
                    n -= 1
                if len(at) > 1:
                    numbers = np.arange(n + 1, n + len(at))
                    yield documents(
                        self.key, phase, numbers, at[:-1] + width, np.diff(at) // width - 1
                    )
                self.last[phase], self.ends[phase] = int(at[-1]), n + len(at)
            self.size += len(data)
            if len(self.head) < width - 1:
                self.head = (self.head + data)[: width - 1]
            self.tail = buffer[-(width - 1) :]

        def summary(self) -> pa.RecordBatch:
            known = [self.size, self.head, self.tail, self.first, self.last, self.ends]
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array([v], t) for v, t in zip(self.key, (pa.string(), pa.int64(), pa.int64()))),
                    pa.nulls(1, pa.int32()),
                    *(pa.nulls(1, pa.int64()) for _ in range(3)),
                    *(pa.array([v], field.type) for v, field in zip(known, state)),
                ],
                names=names,
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            lines, begins, sizes = batch.column(0), *(batch.column(k).to_numpy() for k in (2, 3))
            paths = batch.column(1).dictionary_encode()
            files_of = paths.indices.to_numpy()
            sizes_of = pc.binary_length(lines).to_numpy().astype(np.int64) + len(cut_at)
            weight = np.cumsum(sizes_of) // (block * width)
            cut = (np.diff(files_of) != 0) | (np.diff(begins) != 0) | (np.diff(weight) != 0)
            edges = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                key = (paths.dictionary[files_of[low]].as_py(), int(begins[low]), int(sizes[low]))
                if now is None or now.key != key:
                    if now is not None:
                        yield now.summary()
                    now = Range(key)
                data = cut_at.join([*lines.slice(low, high - low).to_pylist(), b""])
                yield from now.search(data)
        if now is not None:
            yield now.summary()

    return files.mapInArrow(
        scan,
        "path string, range bigint, file_size bigint, phase int, k bigint, start bigint,"
        " n_tokens bigint, size bigint, head binary, tail binary, firsts array<bigint>,"
        " lasts array<bigint>, ends array<bigint>",
    )


def stitched(ranges: DataFrame, end: bytes) -> DataFrame:
    """The prefix scan: of every range where it lies (``offset``), its ``phase``,
    the separators before its own (``base``), and the documents ``open`` before it
    that end in it, at its border, or with the file."""
    width = len(end)
    in_file = Window.partitionBy("path").orderBy("range")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("size").over(Window.partitionBy("path"))
    none = F.lit(0).cast("bigint")
    # a last line without an end was given one; the mark of UTF-8 was skipped
    more = len(line_end(end))
    beyond = total - F.col("file_size")
    skipped = (
        F.when(F.col("file_size") % width != 0, F.raise_error(F.lit("a file is not whole ids")))
        .when(beyond.isin(0, more), none)
        .when(beyond.isin(-len(MARK), more - len(MARK)), F.lit(len(MARK)).cast("bigint"))
        .otherwise(F.raise_error(F.lit("the ranges of a file do not add up")))
    )
    placed = ranges.withColumn(
        "offset", F.coalesce(F.sum("size").over(before), none) + skipped
    ).withColumn("over", F.col("offset") % width)
    # a range may have fewer bytes than an id
    tails = [F.coalesce(F.lag("tail", k).over(in_file), F.lit(b"")) for k in range(width - 1, 0, -1)]
    tail = F.concat(F.lit(MARK), *tails)
    over = F.col("over").cast("int")
    cut = F.concat(
        F.substring(tail, F.octet_length(tail) - over + 1, over),
        F.substring(F.col("head"), F.lit(1), F.lit(width) - over),
    )

    def own(column: str) -> Column:
        return F.element_at(column, F.col("phase") + 1)

    known = (
        placed.withColumn("phase", ((width - F.col("over")) % width).cast("int"))
        .withColumn("at_border", F.when((F.col("over") > 0) & (cut == F.lit(end)), F.col("offset") - F.col("over")))
        .withColumn("first", own("firsts") + F.col("offset"))
        .withColumn("last", F.coalesce(own("lasts") + F.col("offset"), "at_border"))
        .withColumn("at_border_n", F.col("at_border").isNotNull().cast("bigint"))
    )
    reached = F.coalesce(F.max("last").over(before), F.lit(-width).cast("bigint"))
    base = F.coalesce(F.sum(own("ends") + F.col("at_border_n")).over(before), none)
    known = known.withColumn("reached", reached).withColumn("base", base)
    known = known.withColumn("final", F.lead("range").over(in_file).isNull())

    def opening(ordinal: Column, after: Column, closing: Column) -> Column:
        return F.struct(
            ordinal.alias("ordinal"),
            F.floor((after + width) / width).alias("start"),
            (F.floor((closing - after) / width) - 1).alias("n_tokens"),
        )

    at_border = opening(F.col("base"), F.col("reached"), F.col("at_border"))
    first = opening(
        F.col("base") + F.col("at_border_n"), F.coalesce("at_border", "reached"), F.col("first")
    )
    latest = F.coalesce("last", "reached")
    last = opening(
        F.col("base") + F.col("at_border_n") + own("ends"), latest, F.col("file_size")
    )
    docs = F.array(
        F.when(F.col("at_border").isNotNull(), at_border),
        F.when(F.col("first").isNotNull(), first),
        F.when(F.col("final") & (latest + width < F.col("file_size")), last),
    )
    return known.select(
        "path",
        "range",
        "phase",
        "offset",
        (F.col("base") + F.col("at_border_n")).alias("base"),
        F.array_compact(docs).alias("open"),
    )


def token_counts(
    spark: SparkSession,
    path: str,
    separator: int = SEPARATOR,
    block: int = BLOCK,
    width: int = WIDTH,
) -> DataFrame:
    """``path``, ``ordinal`` (from 0, in its file), ``start`` (in ids) and
    ``n_tokens`` of every document in the flat files under ``path``."""
    end = separator.to_bytes(width, "little")
    lines = (
        spark.read.option("lineSep", line_end(end).decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("recursiveFileLookup", "true")
        .text(path)
    )
    hidden = lines.metadataColumn("_metadata")
    files = lines.select(
        F.col("value").cast("binary").alias("value"),
        hidden["file_path"].alias("path"),
        hidden["file_block_start"].alias("range"),
        hidden["file_size"].alias("file_size"),
    )
    found = staged(scan_ranges(files, end, block), "ranges")
    ranges = stitched(found.where("phase is null").drop("phase", "k", "start", "n_tokens"), end)
    opening = ranges.select("path", F.inline("open"))
    inner = found.where("phase is not null").select("path", "range", "phase", "k", "start", "n_tokens")
    inner = inner.join(ranges.drop("open"), ["path", "range", "phase"]).select(
        "path",
        (F.col("base") + F.col("k")).alias("ordinal"),
        F.floor((F.col("offset") + F.col("start")) / width).alias("start"),
        "n_tokens",
    )
    return opening.union(inner)


def document_counts(index: DataFrame, counts: DataFrame) -> DataFrame:
    """``id`` and ``n_tokens`` of every row of ``index``, which ``write_token_files``
    gave, from the ``counts`` of the files that it wrote.

    Documents stand in a file in the order of their rows, so the n-th row of a
    part of a table is the n-th document of the files named after that part; the
    ranks are within a file's bounded number of documents.
    """
    of = [F.regexp_extract("path", r"run=(-?\d+)_(\d+)_(\d+)", k).cast("bigint") for k in (1, 2, 3)]
    names = ["of_file", "of_chunk", "of_first"]
    named = counts.select(*[c.alias(n) for c, n in zip(of, names)], "ordinal", "n_tokens")
    in_files = Window.partitionBy("of_file", "of_chunk").orderBy("of_first", "ordinal")
    in_table = Window.partitionBy("file", "chunk").orderBy("place")
    named = named.withColumn("of_rank", F.row_number().over(in_files))
    ranked = index.withColumn("rank", F.row_number().over(in_table))
    same = [F.col(n) == F.col(f"of_{n}") for n in ("file", "chunk", "rank")]
    return ranked.join(named, same).select("id", "n_tokens")
