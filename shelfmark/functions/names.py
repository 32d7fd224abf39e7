"""Column-name arguments."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(names: str | Iterable[str]) -> list[str]:
    """One name or several, as a list."""
    return [names] if isinstance(names, str) else list(names)


def reject_clash(names: Iterable[str], produced: Iterable[str]) -> None:
    """Fail early when a given column has the name of a column the report adds."""
    produced = {p.lower() for p in produced}  # Spark takes names in any case
    clash = sorted(n for n in names if n.lower() in produced)
    if clash:
        raise ValueError(f"columns {clash} have the name of a report column")


def null_safe(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    """Equality of each (left, right) column pair, null equal to null.

    Besides letting null groups meet, this keeps both join inputs fresh from a
    shuffle, as a preceding aggregation's partitioning is not taken over: the
    form in which adaptive execution can split a skewed partition.
    """
    same = F.lit(True)
    for a, b in pairs:
        same = same & left[a].eqNullSafe(right[b])
    return same
