"""Reports about collections of items held in Spark DataFrames.

A collection is a DataFrame with one row per item: attribute columns to group
by, optionally a content column (what the item is) and a time column. Reports
take DataFrames and return lazy DataFrames; ``Holdings.write`` runs a job and
``append_arrivals`` starts a query.
"""

from shelfmark.operators.composition import composition, share
from shelfmark.operators.concentration import concentration, concentration_curve
from shelfmark.operators.coverage import coverage_gap, flag_rate
from shelfmark.operators.duplicates import exact_duplicates
from shelfmark.operators.growth import growth
from shelfmark.operators.overlap import overlap_depth, overlap_summary, overlap_with
from shelfmark.operators.profile import profile
from shelfmark.plans.holdings import Holdings
from shelfmark.streaming.arrivals import (
    append_arrivals,
    arrivals,
    compact_arrivals,
    read_arrivals,
)

__all__ = [
    "Holdings",
    "append_arrivals",
    "arrivals",
    "compact_arrivals",
    "composition",
    "concentration",
    "concentration_curve",
    "coverage_gap",
    "exact_duplicates",
    "flag_rate",
    "growth",
    "overlap_depth",
    "overlap_summary",
    "overlap_with",
    "profile",
    "read_arrivals",
    "share",
]
