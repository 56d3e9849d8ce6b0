"""Time-grain truncation to a ``period`` date.

All grains are computed on the *date* of the value with ``trunc`` (DateType in,
DateType out), so the result does not depend on the session time zone for
``timestamp_ntz`` and ``date`` inputs.  Weeks start on Monday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starmart.errors import IntentError
from starmart.spec import TIME_GRAINS

PERIOD = "period"

# Grain name -> trunc() unit.
_TRUNC_UNIT = {
    "weekly": "week",
    "monthly": "month",
    "quarterly": "quarter",
    "yearly": "year",
}


def period(col: Column | str, grain: str) -> Column:
    """The first day of the period of ``col`` at ``grain`` (a DateType column)."""
    if grain not in TIME_GRAINS:
        raise IntentError(f"cannot truncate to {grain!r}: the grains are {', '.join(sorted(TIME_GRAINS))}")
    day = (F.col(col) if isinstance(col, str) else col).cast("date")
    if grain == "daily":
        return day
    return F.trunc(day, _TRUNC_UNIT[grain])


def coarser_or_equal(fine: str, coarse: str) -> bool:
    """Can periods at ``fine`` be rolled up exactly into periods at ``coarse``?"""
    order = {"daily": 0, "weekly": 1, "monthly": 2, "quarterly": 3, "yearly": 4}
    if fine == coarse:
        return True
    if fine == "weekly":
        # Monday weeks straddle month/quarter/year boundaries.
        return False
    return order[fine] <= order[coarse]
