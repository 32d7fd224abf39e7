"""Removal of long passages that a corpus holds more than once.

By prefix-free parsing: a rolling hash picks trigger places, which cut the texts
into phrases. Here the trigger of a 200-byte string is the place of the least
hash of its 64-byte strings, the first of equals. Equal strings have equal
triggers, so the strings starting at neighbouring places that share a trigger
form a phrase, and a phrase overlaps the next one by so much that every string
lies in exactly one. The corpus is then its dictionary of different phrases and
the parse, which says where each occurs.

A string is cut at its trigger in two: a suffix of the phrase up to and with the
trigger, and a prefix of what the parse goes on with from the trigger. No string
can be cut otherwise, so two strings are equal if both parts are. Two suffix
arrays order the parts. That of the dictionary has the phrases up to their
triggers, compared from the trigger backwards, so that phrases with a common
suffix are neighbours; that of the parse has what follows each trigger. The
length that neighbours have in common gives, for each length, the first place
with the same bytes: a rank. The pair of ranks is a string's place in the order
of the corpus, and strings with equal pairs are repeats.

Only phrases that share their trigger string with a different phrase need this;
a phrase that occurs twice is a repeat as a whole. Both arrays are sorted by
ranges, so a trigger in a third of all documents is shared by many tasks, and
classes of equal parts that go over the border of a range take the rank that
they have in the range before. Of the strings only those go on whose two parts
are both held by another phrase.

Defined results: a null text is empty and nothing of it is removed; equal texts
are copies of each other, also as repeated rows; strings shorter than the
length are never repeats; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.functions.names import null_safe
from shelfmark.llm.staging import staged

LENGTH = 200
TRIGGER = 64  # a power of two
BUFFER = 1 << 20  # bytes that are parsed at once; places in it take 20 bits
ROWS = 1000  # texts whose phrases are held at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64(BUFFER - 1)


def trigger_places(data: bytes, length: int, trigger: int) -> np.ndarray:
    """For every place of ``data`` where a string of ``length`` bytes starts: the
    place of its trigger."""
    h, span, power = np.frombuffer(data, np.uint8).astype(np.uint64), 1, _BASE
    while span < trigger:
        h = h[:-span] * power + h[span:]
        power, span = np.uint64(int(power) ** 2 % (1 << 64)), 2 * span
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = length - trigger + 1
    n = len(data) - length + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (least & _PLACE).astype(np.int64)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


# trigger string, phrase, place of the phrase, strings starting in it, place of the
# trigger in the phrase
Phrase = tuple[int, int, int, int, int]


def phrases(texts: list[bytes], length: int, trigger: int) -> list[list[Phrase]]:
    """The phrases of each text."""
    found: list[list[Phrase]] = [[] for _ in texts]
    # pieces overlap so that every string starts in one of them
    pieces = [
        (k, at, text[at : at + BUFFER - 1])
        for k, text in enumerate(texts)
        for at in range(0, max(1, len(text) - length + 1), BUFFER - length)
        if len(text) >= length
    ]
    while pieces:
        size, n = 0, 0
        while n < len(pieces) and size + len(pieces[n][2]) < BUFFER:
            size += len(pieces[n][2])
            n += 1
        now, pieces = pieces[:n], pieces[n:]
        data = b"".join(p[2] for p in now)
        starts = np.cumsum([0] + [len(p[2]) for p in now])
        place = trigger_places(data, length, trigger)
        inside = np.zeros(len(place) + length, np.int8)
        np.add.at(inside, starts[:-1], 1)
        np.add.at(inside, starts[1:] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[: len(place)]))
        own = place[at]
        first = np.flatnonzero(
            np.concatenate([[True], (np.diff(own) != 0) | (np.diff(at) != 1)])
        )
        count = np.diff(np.concatenate([first, [len(at)]]))
        begins = at[first]
        piece = np.searchsorted(starts, begins, "right") - 1
        digest = xxhash.xxh3_64_intdigest
        for k, begin, t, c in zip(
            piece.tolist(), begins.tolist(), own[first].tolist(), count.tolist()
        ):
            text, offset, _ = now[k]
            found[text].append(
                (
                    _signed(digest(data[t : t + trigger])),
                    _signed(digest(data[begin : begin + c + length - 1], t - begin)),
                    begin - int(starts[k]) + offset,
                    c,
                    t - begin,
                )
            )
    return found


_PHRASE = pa.struct(
    [
        ("key", pa.int64()),
        ("phrase", pa.int64()),
        ("at", pa.int64()),
        ("strings", pa.int32()),
        ("lead", pa.int32()),
    ]
)


def _identity(text: Column) -> list[Column]:
    """128 bits that tell a text from any other."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def parse(texts: DataFrame, length: int, trigger: int) -> DataFrame:
    """``d1``, ``d2`` and the phrases of every row of ``texts`` (``d1, d2, text``)."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            own = phrases([t.as_py().encode() for t in batch.column(2)], length, trigger)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in own])])
            flat = [p for text in own for p in text]
            columns = zip(*flat) if flat else [()] * len(_PHRASE)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _PHRASE)]
            struct = pa.StructArray.from_arrays(arrays, names=[f.name for f in _PHRASE])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists], names=["d1", "d2", "phrases"]
            )

    return texts.mapInArrow(
        parsed,
        "d1 bigint, d2 bigint,"
        " phrases array<struct<key:bigint,phrase:bigint,at:bigint,strings:int,lead:int>>",
    )


def kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Removed bytes, removed runs, and the digest of what stays."""
    digest, reached, removed, runs = hashlib.sha256(), 0, 0, 0
    for begin, end in sorted(spans):
        if begin > reached or not runs:
            digest.update(text[reached:begin])
            runs += 1
            removed += end - begin
            reached = end
        elif end > reached:
            removed += end - reached
            reached = end
    digest.update(text[reached:])
    return removed, runs, digest.hexdigest()


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """First and last of every run of neighbouring numbers."""
    runs: list[list[int]] = []
    for p in sorted(places):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return [(a, b) for a, b in runs]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes at the start are the same."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    k = int(differ.argmax()) if n else 0
    return k if n and differ[k] else n


# Of a part in its suffix array: its range, the bytes in common with a neighbour,
# and its ranks as (from this length on, rank). The first and the last of a range
# (edge 1, 2, or 3 for both) come with their bytes and the ranks of all lengths.
_RANKED = (
    "uid bigint, at bigint, lead int, strings int, single boolean,"
    " range long, edge int, reach int, lengths array<int>, ranks array<long>, part binary"
)
_RANGE = 40  # a rank is the number of its range and, in so many bits, a place in it


def _ranked(length: int, trigger: int, schema: pa.Schema):
    """Over the parts of one range in order (``uid, at, lead, strings, single,
    part``): their ranks, of parts that have their trigger in common with another."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        first = np.full(length + 1, own << _RANGE)
        held, n, before = None, 0, 0

        def row(after: int, last: bool):
            edge = (n == 1) + 2 * last
            reach = max(before, after)
            upto = min(len(held[-1]), length) if edge else reach
            if upto < trigger:
                return
            ranks = first[trigger : upto + 1]
            new = np.concatenate([[0], np.flatnonzero(np.diff(ranks)) + 1])
            part = held[-1].tobytes() if edge else None
            yield (*held[:-1], own, edge, reach, (new + trigger).tolist(), ranks[new].tolist(), part)

        def made(rows):
            columns = zip(*rows) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names
            )

        for batch in batches:
            rows = []
            for *who, part in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(part, np.uint8)
                if held is not None:
                    after = common(held[-1], part)
                    rows += row(after, False)
                    before = after
                    first[after + 1 :] = (own << _RANGE) + n
                held, n = (*who, part), n + 1
            yield made(rows)
        yield made(list(row(0, True)) if held is not None else [])

    return scan


def _expanded(lengths: list[int], ranks: list[int], trigger: int, upto: int) -> np.ndarray:
    """The rank for each length from ``trigger`` to ``upto``."""
    wanted = np.arange(trigger, upto + 1)
    return np.asarray(ranks, np.int64)[np.searchsorted(lengths, wanted, "right") - 1]


# by range: bytes in common with the range before, ranks there, bytes in common with
# the range after
Borders = dict[int, tuple[int, np.ndarray, int]]


def borders(edges: list, length: int, trigger: int) -> Borders:
    """What parts at the borders of ranges have in common; ``edges`` are the first
    and last rows of all ranges, two of each."""
    firsts = {e["range"]: e for e in edges if e["edge"] & 1}
    lasts = {e["range"]: e for e in edges if e["edge"] & 2}
    found: Borders = {}
    shared, ranks = 0, np.zeros(0, np.int64)
    order = sorted(firsts)
    for own, following in zip(order, [*order[1:], None]):
        last = lasts[own]
        after = 0
        if following is not None:
            parts = (np.frombuffer(e["part"], np.uint8) for e in (last, firsts[following]))
            after = min(common(*parts), length)
        found[own] = (shared, ranks, after)
        below = _expanded(last["lengths"], last["ranks"], trigger, after)
        shared, ranks = after, _over_border(below, own, ranks)
    return found


def _over_border(ranks: np.ndarray, own: int, above: np.ndarray) -> np.ndarray:
    """``ranks`` with those of the range before where the part goes on from there."""
    n = min(len(ranks), len(above))
    ranks[:n] = np.where(ranks[:n] == own << _RANGE, above[:n], ranks[:n])
    return ranks


def _whole(side: dict, around: Borders, trigger: int) -> np.ndarray:
    """The ranks of a part for the lengths that it has in common with another."""
    own, edge, reach = side["range"], side["edge"], side["reach"]
    shared, above, after = around[own]
    if edge & 1:
        reach = max(reach, shared)
    if edge & 2:
        reach = max(reach, after)
    return _over_border(_expanded(side["lengths"], side["ranks"], trigger, reach), own, above)


def _paired(length: int, trigger: int, left: Borders, right: Borders):
    """Over phrases with the ranks of both parts: the strings whose parts are both
    held by another phrase, with their two ranks."""
    names = ["uid", "single", "place", "size", "left", "right"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
                found = [[np.zeros(0, np.int64)] for _ in names]
                for p in part.to_pylist():
                    a = _whole(p["a"], left, trigger)
                    b = _whole(p["b"], right, trigger)
                    # the string at ``k`` has ``size`` bytes up to the trigger's end
                    # and ``length + trigger - size`` from its start
                    low = max(0, p["lead"] + 1 - len(a))
                    high = min(p["strings"], len(b) + trigger + p["lead"] - length)
                    if low >= high:
                        continue
                    k = np.arange(low, high)
                    size = p["lead"] + trigger - k
                    same = [np.full(len(k), p[c]) for c in ("uid", "single")]
                    ranks = [a[size - trigger], b[k + length - p["lead"] - trigger]]
                    for column, values in zip(found, [*same, p["at"] + k, size, *ranks]):
                        column.append(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(k.to_pandas_dtype())) for c, k in zip(found, kinds)],
                    names=names,
                )

    return pair, "uid bigint, single boolean, place bigint, size int, left bigint, right bigint"


def repeated_strings(entries: DataFrame, length: int, trigger: int) -> DataFrame:
    """Of the phrases in ``entries`` (``uid, at, single, lead, strings, text``), those
    that are ``single`` in the corpus: ``uid`` and, in its text, the ``places`` of
    strings that another phrase holds too.
    """

    def array(part: Column, purpose: str) -> tuple[DataFrame, Borders]:
        parts = entries.select("uid", "at", "lead", "strings", "single", part.alias("part"))
        schema = T.StructType.fromDDL(_RANKED)
        scan = _ranked(length, trigger, to_arrow_schema(schema))
        ranked = staged(
            parts.repartitionByRange("part", "uid", "at")
            .sortWithinPartitions("part", "uid", "at")
            .mapInArrow(scan, schema),
            purpose,
        )
        edges = ranked.where("edge > 0").collect()
        return ranked.drop("part"), borders(edges, length, trigger)

    # compared from the trigger's end backwards
    text = F.col("text")
    upto = F.substring(text, F.lit(1), F.col("lead") + trigger)
    backwards = F.unhex(F.regexp_replace(F.reverse(F.hex(upto)), "(.)(.)", "$2$1"))
    dictionary, left = array(backwards, "dictionary-suffixes")
    onwards = F.substring(text, F.col("lead") + 1, F.lit(length))
    parse, right = array(onwards, "parse-suffixes")

    side = ["range", "edge", "reach", "lengths", "ranks"]
    pair, schema = _paired(length, trigger, left, right)
    both = dictionary.select(
        "uid", "at", "lead", "strings", "single", F.struct(*side).alias("a")
    ).join(parse.select("uid", "at", F.struct(*side).alias("b")), ["uid", "at"])
    strings = staged(both.mapInArrow(pair, schema), "strings")
    place = ["size", "left", "right"]
    often = strings.groupBy(*(F.col(c).alias(f"_{c}") for c in place)).agg(
        F.count(F.lit(1)).alias("times")
    )
    often = often.where("times > 1")
    return (
        strings.where("single")
        .join(often, null_safe(strings, often, [(c, f"_{c}") for c in place]), "left_semi")
        .groupBy("uid")
        .agg(F.collect_list("place").alias("places"))
    )


def _step_schema(id_type: T.DataType) -> T.StructType:
    long, integer, binary = T.LongType(), T.IntegerType(), T.BinaryType()

    def rows(**fields):
        return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))

    return T.StructType(
        [T.StructField("id", id_type)]
        + [T.StructField(c, long) for c in ("d1", "d2", "n_bytes", "n_removed", "n_spans")]
        + [
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("open", binary),
            T.StructField("spans", rows(low=long, high=long)),
            T.StructField(
                "slices",
                rows(
                    uid=long,
                    at=long,
                    single=T.BooleanType(),
                    lead=integer,
                    strings=integer,
                    text=binary,
                ),
            ),
        ]
    )


def _first_look(length: int):
    """Documents with what is known of them: finished if nothing of them is open,
    and the slices that are to be compared."""

    def look(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            notes = batch.column(4).to_pylist()
            for row, (value, own) in enumerate(zip(batch.column(3), notes)):
                text = value.as_py().encode()
                spans, slices, open_text = [], [], None
                for note in own or ():
                    at, end = note["at"], note["at"] + note["strings"] + length - 1
                    if note["uid"] is None:
                        spans.append((at, end))
                        continue
                    if note["single"]:
                        open_text = text
                    slices.append(note | {"text": text[at:end]})
                removed, runs, digest = (None, None, None)
                if open_text is None:
                    removed, runs, digest = kept(text, spans)
                    spans = []
                rows.append(
                    (len(text), removed, runs, digest, open_text,
                     [{"low": a, "high": b} for a, b in spans], slices)
                )
            columns = list(zip(*rows)) if rows else [()] * 7
            arrays = [batch.column(k) for k in range(3)]
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[3:])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return look


def remove_repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    trigger: int = TRIGGER,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_sha256``, every byte being removed that a string of ``length`` bytes
    covers which also starts elsewhere.

    Texts are shuffled once, to meet what was found about them, and those of
    documents with phrases that had to be compared a second time. All else that
    moves is numbers and the compared phrases.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id).alias("id"), *_identity(whole), whole.alias("text"))
    parsed = staged(
        parse(texts.select("d1", "d2", "text"), length, trigger).withColumn(
            "uid", F.monotonically_increasing_id()
        ),
        "parse",
    )
    placed = parsed.select("uid", F.inline("phrases"))
    twice = placed.groupBy(F.col("key").alias("shared")).agg(F.count(F.lit(1)).alias("n"))
    twice = twice.where("n > 1").select("shared")
    placed = staged(
        placed.join(twice, null_safe(placed, twice, [("key", "shared")]), "left_semi"), "phrases"
    )

    # the dictionary: every phrase with its occurrences and one place
    dictionary = staged(
        placed.groupBy("key", "phrase").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("uid", "at", "strings", "lead")).alias("one"),
        ),
        "dictionary",
    )
    mixed = dictionary.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("different"))
    mixed = mixed.where("different > 1")
    asked = dictionary.join(mixed, null_safe(dictionary, mixed, [("key", "of")])).select(
        "n", "one.*"
    )
    repeats = dictionary.where("n > 1").select("key", "phrase")
    sure = placed.join(repeats, ["key", "phrase"]).select(
        "uid",
        F.struct(
            F.lit(None).cast("bigint").alias("uid"),
            "at",
            F.lit(False).alias("single"),
            F.lit(0).alias("lead"),
            "strings",
        ).alias("note"),
    )
    asking = asked.select(
        "uid",
        F.struct("uid", "at", (F.col("n") == 1).alias("single"), "lead", "strings").alias("note"),
    )
    owners = parsed.select("uid", "d1", "d2")
    notes = (
        sure.union(asking)
        .join(owners, "uid")
        .groupBy(F.col("d1").alias("n1"), F.col("d2").alias("n2"))
        .agg(F.collect_set("note").alias("notes"))
    )
    schema = _step_schema(docs.schema[id].dataType)
    arrow, look = to_arrow_schema(schema), _first_look(length)
    seen = staged(
        texts.join(notes, null_safe(texts, notes, [("d1", "n1"), ("d2", "n2")]), "left")
        .select("id", "d1", "d2", "text", "notes")
        .mapInArrow(lambda batches: look(batches, arrow), schema),
        "seen",
    )
    # copies of a document give the same slices; a phrase is known by the first place
    # it has, so of equal texts one only is the owner of phrases
    slices = seen.select(F.inline("slices")).groupBy("uid", "at", "single", "lead", "strings")
    entries = staged(slices.agg(F.max("text").alias("text")), "entries")
    more = (
        repeated_strings(entries, length, trigger)
        .join(owners, "uid")
        .select("d1", "d2", "places")
    )
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans, places in zip(
                batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3))
            ):
                own = [(s["low"], s["high"]) for s in spans]
                own += [(a, b + length) for a, b in _runs(places or [])]
                content = value.as_py()
                rows.append((len(content), *kept(content, own)))
            columns = zip(*rows) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["id", *results],
            )

    final = T.StructType([schema["id"], *[schema[c] for c in results]])
    reopened = (
        seen.where("open is not null")
        .select("id", "d1", "d2", "open", "spans")
        .join(more, ["d1", "d2"], "left")
        .select("id", "open", "spans", "places")
        .mapInArrow(finish, final)
    )
    done = seen.where("open is null").select("id", *results)
    return done.union(reopened).withColumnRenamed("id", id)
