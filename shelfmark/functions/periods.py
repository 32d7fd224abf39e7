"""Calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# period -> a longer period, of at most 86,400 shorter ones, that a running
# total is first taken within
ENCLOSING = {
    "second": "day",
    "minute": "month",
    "hour": "year",
    "day": "year",
    "week": "year",
    "month": "year",
    "quarter": "year",
    "year": None,
}
SHORT = ("second", "minute", "hour")


def period(df: DataFrame, time: str, unit: str) -> Column:
    """Start of the period that ``time`` falls in.

    A date for day and longer; a timestamp of the column's own type below
    that. Zone-less timestamps are cut without passing through the session
    time zone, so a clock change cannot move them.
    """
    if unit not in ENCLOSING:
        raise ValueError(f"unit {unit!r} is not one of {', '.join(ENCLOSING)}")
    kind = df.schema[time].dataType
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{time} is {kind.simpleString()}, not a date or timestamp")
    at = F.col(time)
    if unit not in SHORT:
        day = at.cast("date")
        return day if unit == "day" else F.trunc(day, unit)
    if isinstance(kind, T.TimestampNTZType):
        second = F.second(at) if unit != "second" else F.lit(0)
        minute = F.minute(at) if unit == "hour" else F.lit(0)
        fraction = F.date_part(F.lit("SECOND"), at) - F.second(at)
        return at - F.make_dt_interval(F.lit(0), F.lit(0), minute, second + fraction)
    if isinstance(kind, T.TimestampType):
        return F.date_trunc(unit, at)
    raise TypeError(f"{time} is a date and has no {unit}")


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def as_instant(at: Column) -> Column:
    """A zone-less timestamp taken for UTC, whatever the session time zone."""
    seconds = (at - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)")
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def as_zoneless(at: Column) -> Column:
    """The reverse of ``as_instant``."""
    seconds = (F.unix_micros(at).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds)
