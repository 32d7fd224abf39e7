"""Near duplicates by SimHash fingerprints.

A document's fingerprint has 64 bits; documents link when theirs differ in at
most four. Four differing bits touch four of the eight bytes at most, so linked
fingerprints agree in four bytes, position by position: the guaranteed minimum
of matches. The inverted index has a posting per fingerprint under triples of
positions with their bytes. The triples are chosen so that any four positions
hold one of them, so every pair with four matches meets under some key; there
its matches are tallied, pairs with fewer than four are dropped, and the rest
verified bit by bit.

Keys with very many postings, as thousands of near copies make, are not paired
up. Two fingerprints are within four bits exactly when some value is within two
bits of each, so those of hot keys are joined on the values near them; all that
share a value are linked, and a link to the smallest of them says so.

Defined results: a text without words (null, empty, blanks) has fingerprint
zero and is linked like any other; repeated rows and equal fingerprints are one
component; a null id takes no part in ``component_id``, which is null where all
ids are; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.names import null_safe
from shelfmark.llm.components import components
from shelfmark.llm.staging import staged

BYTES = 8
DISTANCE = 4
SHINGLE = 4
SEED = 42
# postings of one key that are compared with each other in one task
MOST_IN_KEY = 4096
# pairs held before they are reduced to a forest
MOST_PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []  # A-Z and blanks of ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, BYTES), axis=1).sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight positions, one inside any four of them.

    The positions are cut into three groups in a ring; a triple lies in one
    group, or has two positions in a group and one in the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    shapes = {(0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [
        t
        for t in combinations(range(BYTES), 3)
        if tuple(sorted(group[p] for p in t)) in shapes
    ]


def postings(prints: DataFrame) -> DataFrame:
    """``key`` and ``fp``: each fingerprint under each triple of its bytes."""
    at = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    keys = [
        F.lit(i << 24)
        + F.shiftleft(at[a], 16).cast("bigint")
        + F.shiftleft(at[b], 8).cast("bigint")
        + at[c].cast("bigint")
        for i, (a, b, c) in enumerate(position_triples())
    ]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the pairs connect it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among fingerprints under one key, keys being sorted."""
    least = BYTES - distance
    nodes, node = np.unique(fps, return_inverse=True)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held = step = 0
    at = np.arange(len(keys))
    while len(at):
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        differ = (fps[at] ^ fps[at + step]).view(np.uint64)
        tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        retained = tally >= least
        near = np.flatnonzero(retained)[np.bitwise_count(differ[retained]) <= distance]
        left.append(node[at[near]])
        right.append(node[at[near] + step])
        held += len(near)
        if held > MOST_PAIRS:
            root = forest(len(nodes), np.concatenate(left), np.concatenate(right))
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            left, right, held = [tied], [root[tied]], len(tied)
    root = forest(len(nodes), np.concatenate(left), np.concatenate(right))
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _pair_up(distance: int):
    """Over postings sorted by key: whole keys at a time, a key's last rows are
    carried to the next batch."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys, fps):
            a, b = linked(keys, fps, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield found(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield found(keys, fps)

    return pairs


def flips(distance: int) -> list[int]:
    """Masks of at most half ``distance`` bits, as signed numbers."""
    masks = [
        sum(1 << bit for bit in bits)
        for n in range(distance // 2 + 1)
        for bits in combinations(range(64), n)
    ]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, distance: int = DISTANCE, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all fingerprints linked directly or by
    others. ``prints`` has each fingerprint once, as ``fp``."""
    if distance != DISTANCE:
        raise ValueError("the triples of positions are made for four differing bits")
    index = postings(prints)
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_in_key)
    hot = hot.select(F.col("key").alias("hot"))
    in_hot = null_safe(index, hot, [("key", "hot")])
    cold = (
        index.join(hot, in_hot, "left_anti")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_pair_up(distance), "a bigint, b bigint")
    )
    crowd = index.join(hot, in_hot, "left_semi").select("fp").distinct()
    masks = F.array(*[F.lit(m).cast("bigint") for m in flips(distance)])
    near = crowd.select("fp", F.explode(masks).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), "fp"
    )
    least = near.groupBy(F.col("value").alias("of")).agg(F.min("fp").alias("b"))
    stars = (
        near.join(least, null_safe(near, least, [("value", "of")]))
        .where("fp != b")
        .select(F.col("fp").alias("a"), "b")
    )
    return cold.union(stars)


def near_duplicates(printed: DataFrame, id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``fp``, ``root`` and ``component_id`` of every fingerprint in ``printed``, a
    table of ids with their fingerprints. ``root``, the smallest fingerprint of a
    component, tells it from others also where ids are null or repeat."""
    per_print = printed.groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("least"))
    tied = components(links(per_print.select("fp")))
    rooted = per_print.join(tied, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    same = null_safe(rooted, least, [("root", "_root")])
    return rooted.join(least, same).select("fp", "root", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: its id, ``fingerprint`` and ``component_id``."""
    printed = staged(docs.select(F.col(id).alias("id"), fingerprints(text).alias("fp")), "prints")
    groups = near_duplicates(printed, "id").withColumnRenamed("fp", "_fp")
    return printed.join(groups, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id), as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )
