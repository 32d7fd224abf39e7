"""The identity of an item's content."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.names import as_list, reject_clash


def content_keys(
    df: DataFrame, content: str | Iterable[str], where: Column | None = None
) -> list[Column]:
    """Columns ``_c0``, ``_c1``, ... in which two items agree exactly when their
    content is the same.

    Strings and binaries enter as their SHA-256 (32 bytes), so that a shuffle
    or a hash table never carries whole texts; other types enter as they are.
    Each column's metadata holds its name in a report, which is also kept where
    the keys are written to a table. ``where`` a condition is given, the keys of
    other items are null.
    """
    keys = []
    for i, name in enumerate(as_list(content)):
        key, label = F.col(name), name
        if isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType)):
            key, label = F.unhex(F.sha2(key, 256)), f"{name}_sha256"
        if where is not None:
            key = F.when(where, key)
        keys.append(key.alias(f"_c{i}", metadata={"label": label}))
    if not keys:
        raise ValueError("no content column given")
    return keys


def key_names(columns: Iterable[str]) -> list[str]:
    """The content keys among ``columns``."""
    return [c for c in columns if c.startswith("_c")]


def known(content: str | Iterable[str]) -> Column:
    """Whether an item's content is known, that is, no part of it is null."""
    result = F.lit(True)
    for name in as_list(content):
        result = result & F.col(name).isNotNull()
    return result


def labelled(keyed: DataFrame) -> DataFrame:
    """A report with its content keys under their labels, digests in hexadecimal."""
    keys = key_names(keyed.columns)
    others = [c for c in keyed.columns if c not in keys]
    labels = [keyed.schema[k].metadata.get("label") for k in keys]
    if None in labels:
        raise ValueError(f"{keys} do not tell their names: was the index written by another tool?")
    reject_clash(labels, others)
    columns = []
    for key, label in zip(keys, labels):
        digest = isinstance(keyed.schema[key].dataType, T.BinaryType)
        columns.append((F.lower(F.hex(key)) if digest else F.col(key)).alias(label, metadata={}))
    return keyed.select(*columns, *others)
