"""How filters interact: what each of them removes in every order of applying them.

A document's outcome under all orders follows from its mask, the set of filters
that it fails. For every mask and outcome there is one wide packed counter, a
big integer with a field of 64 bits for each step of each order (5 filters: 120
orders, 600 steps). Documents are counted per part and mask; a part's counters
are the sum of its masks' integers, each times its documents. A field never
holds more than the part's documents, which a 64-bit count bounds, so no field
runs over into the next, and the sums are unpacked as they are.

What moves are a document's id, part, mask and the digest of its text, then one
row per part, mask and label.

Defined results: a null text is empty, a null part an empty string; a null id is
smaller than no other and has no label; repeated rows count each, and rows that
share a ``doc_id`` are not smaller than each other; of several labels of one
document any good or toxic one counts; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.functions.names import null_safe
from shelfmark.llm.staging import staged

# fixed values of the contract
FILTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"

FIELD = 64  # bits of a field of a counter
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
COUNTS = (*OUTCOMES, "good_lost", "toxic_lost", "shapley")


def text_failures(text: str) -> int:
    """The filters that look at one text alone, as bits A to D."""
    raw = text.encode()
    words = raw.split()  # at the six blanks and no others
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * len(text)) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


@F.arrow_udf(T.IntegerType())
def failures(texts: pa.Array) -> pa.Array:
    return pa.array([text_failures(t.as_py() or "") for t in texts], pa.int32())


def filter_masks(
    docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``id``, ``part`` and ``mask`` of every document, bit k standing for the
    k-th of ``FILTERS``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    measured = staged(
        docs.select(
            F.col(id).alias("id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            failures(F.col(text)).alias("mask"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
        ),
        "masks",
    )
    firsts = (
        measured.groupBy(F.col("digest").alias("of"))
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last")
    )
    copied = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return measured.join(firsts, null_safe(measured, firsts, [("digest", "of")]), "left").select(
        "id", "part", F.col("mask").bitwiseOR(F.when(copied, 16).otherwise(0)).alias("mask")
    )


def mask_counts(
    masks: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """Per ``part`` and ``mask``: ``n`` documents, ``n_good`` and ``n_toxic`` ones."""
    known = (
        labels.where(F.col(id).isNotNull())
        .groupBy(F.col(id).alias("of"))
        .agg(
            F.max((F.col(good) == 1).cast("int")).alias("good"),
            F.max((F.col(toxic) == 1).cast("int")).alias("toxic"),
        )
    )
    # ids that are null meet nothing, and may be many: the join is in the form that is split
    return (
        masks.join(known, null_safe(masks, known, [("id", "of")]), "left")
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("n_good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("n_toxic"),
        )
    )


@lru_cache(maxsize=4)
def packed(n_filters: int) -> dict[str, list[int]]:
    """Of each outcome a big integer per mask: field ``n_filters * order + step``
    is 1 where documents of the mask have that outcome at that step."""
    orders = list(permutations(range(n_filters)))
    counters = {name: [0] * (1 << n_filters) for name in OUTCOMES}
    for mask in range(1 << n_filters):
        at = 0
        for order in orders:
            gone = False
            for own in order:
                fails = bool(mask >> own & 1)
                for name, holds in (
                    ("kept", not gone and not fails),
                    ("removed", not gone and fails),
                    ("redundant", gone and fails),
                    ("unique_fails", mask == 1 << own),
                ):
                    counters[name][mask] += holds << at
                gone = gone or fails
                at += FIELD
    return counters


def unpacked(counter: int, n_fields: int) -> np.ndarray:
    return np.frombuffer(counter.to_bytes(n_fields * FIELD // 8, "little"), "<i8")


def interaction_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per ``part``, ``filter_order`` and ``step`` the columns of ``COUNTS``.

    ``counts`` has the rows of ``mask_counts``: at most one per part and mask,
    so that a part is a bounded group whatever its documents.
    """
    k = len(filters)
    n_fields = k * factorial(k)
    schema = T.StructType().add("part", "string").add("filter_order", "string").add("step", "integer")
    for name in COUNTS:
        schema = schema.add(name, "long")
    arrow = to_arrow_schema(schema)

    def audit(table: pa.Table) -> pa.Table:
        counters = packed(k)
        masks = table["mask"].to_pylist()

        def total(outcome: str, weight: str) -> np.ndarray:
            own = zip(masks, table[weight].to_pylist())
            return unpacked(sum(n * counters[outcome][mask] for mask, n in own), n_fields)

        fields = [total(name, "n") for name in OUTCOMES]
        fields += [total("removed", "n_good"), total("removed", "n_toxic")]
        orders = np.array(list(permutations(range(k))))
        removed = fields[OUTCOMES.index("removed")]
        shapley = np.zeros(k, np.int64)
        np.add.at(shapley, orders.ravel(), removed)
        names = ["".join(filters[f] for f in order) for order in orders.tolist() for _ in order]
        return pa.Table.from_arrays(
            [
                pa.array([table["part"][0].as_py()] * n_fields),
                pa.array(names),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))),
                *(pa.array(f) for f in (*fields, shapley[orders.ravel()])),
            ],
            schema=arrow,
        )

    return counts.groupBy("part").applyInArrow(audit, schema)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``FILTERS`` over ``docs`` with their ``labels``."""
    return interaction_audit(mask_counts(filter_masks(docs), labels))
