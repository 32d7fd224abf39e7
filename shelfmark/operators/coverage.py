"""Which items have a counterpart elsewhere, and what does it say of them?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.names import as_list, null_safe, reject_clash


def _items_per_key(df: DataFrame, on: list[str], by: list[str], fold: bool) -> DataFrame:
    """Items as (join key, group, how many), under names nothing else uses."""
    cols = [F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]
    cols += [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    items = df.select(*cols)
    if fold:
        return items.groupBy(*items.columns).agg(F.count(F.lit(1)).alias("_n"))
    return items.withColumn("_n", F.lit(1).cast("bigint"))


def _known(on: list[str]) -> Column:
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    return known


def _rows_per_key(
    df: DataFrame, on: list[str], columns: dict[str, Column] | None = None
) -> DataFrame:
    """The other table folded to one row per known key, aggregating ``columns``."""
    grouped = df.where(_known(on)).groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(on)])
    rows = F.count(F.lit(1)).alias("_m")
    return grouped.agg(rows, *[v.alias(k) for k, v in (columns or {}).items()])


def _same_key(items: DataFrame, rows: DataFrame, on: list[str]) -> Column:
    return null_safe(items, rows, [(f"_on{i}", f"_key{i}") for i in range(len(on))])


def _groups(by: list[str]) -> list:
    return [F.col(f"_by{i}").alias(c) for i, c in enumerate(by)]


def coverage_gap(
    df: DataFrame,
    other: DataFrame,
    on: str | Iterable[str],
    by: str | Iterable[str],
    other_on: str | Iterable[str] | None = None,
    fold: bool = True,
) -> DataFrame:
    """Per group: items, and items with no row in ``other`` for their key.

    An item whose key is null has no counterpart. ``other_on`` names the key
    columns in ``other`` where they differ.

    With ``fold`` the items of equal key and group become one row before they
    are shuffled for the join. Where few are equal (``on`` is the items' own
    key, say), ``fold=False`` gives the same and saves a shuffle. A frequent
    key's partition is then left to adaptive execution to split, which goes by
    its compressed bytes and so finds many equal rows late.
    """
    on, by = as_list(on), as_list(by)
    other_on = on if other_on is None else as_list(other_on)
    if len(other_on) != len(on):
        raise ValueError(f"{len(on)} key columns against {len(other_on)}")
    reject_clash(by, ["n_items", "n_missing"])
    # items of unknown key match nothing; the join deals them out by their own turn
    unknown = ~_known([f"_on{i}" for i in range(len(on))])
    spread = F.when(unknown, F.monotonically_increasing_id() + 1).otherwise(F.lit(0))
    items = _items_per_key(df, on, by, fold).withColumn("_spread", spread)
    there = _rows_per_key(other, other_on).withColumn("_met", F.lit(0).cast("bigint"))
    missing = F.when(F.col("_m").isNull(), F.col("_n")).otherwise(F.lit(0))
    return (
        items.join(there, _same_key(items, there, on) & (items["_spread"] == there["_met"]), "left")
        .groupBy(*_groups(by))
        .agg(F.sum("_n").alias("n_items"), F.sum(missing).alias("n_missing"))
    )


def flag_rate(
    df: DataFrame,
    flags: DataFrame,
    on: str | Iterable[str],
    by: str | Iterable[str],
    names: str | Iterable[str],
    flags_on: str | Iterable[str] | None = None,
    fold: bool = True,
) -> DataFrame:
    """Per group: item-and-flag rows joined on ``on`` (``n_flagged``), and the
    total of each flag; a flag's rate is its total by ``n_flagged``.

    Equal to an inner join followed by sums, but the flags are totalled per key
    first and multiplied by the items' count, so a key frequent on both sides
    does not make a row per pair. ``fold`` is as in ``coverage_gap``; items are
    not folded where a flag is a decimal, as a count times a decimal would lose
    digits. Totals have the type of a plain sum. Items of unknown key are left
    out before anything is shuffled.
    """
    on, by, names = as_list(on), as_list(by), as_list(names)
    flags_on = on if flags_on is None else as_list(flags_on)
    if len(flags_on) != len(on):
        raise ValueError(f"{len(on)} key columns against {len(flags_on)}")
    reject_clash(by, ["n_flagged", *names])
    reject_clash(names, ["n_flagged"])
    if len({c.lower() for c in names}) < len(names):
        raise ValueError(f"flags {names} repeat")
    kinds = [flags.schema[c].dataType for c in names]
    exact = [isinstance(k, T.DecimalType) for k in kinds]
    items = _items_per_key(df.where(_known(on)), on, by, fold and not any(exact))
    sums = {f"_flag{i}": F.sum(c) for i, c in enumerate(names)}
    per_key = _rows_per_key(flags, flags_on, sums)
    return (
        items.join(per_key, _same_key(items, per_key, on))
        .groupBy(*_groups(by))
        .agg(
            F.sum(F.col("_n") * F.col("_m")).alias("n_flagged"),
            *[
                F.sum(F.col(f"_flag{i}") if any(exact) else F.col("_n") * F.col(f"_flag{i}"))
                .cast(T.DecimalType(min(38, kind.precision + 10), kind.scale) if own else per_key.schema[f"_flag{i}"].dataType)
                .alias(c)
                for i, (c, kind, own) in enumerate(zip(names, kinds, exact))
            ],
        )
    )
