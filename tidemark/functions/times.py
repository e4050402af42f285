"""Times as numbers that don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_micros(c: Column, naive: bool = True) -> Column:
    """Microseconds since 1970 UTC.

    ``naive``: the column has no zone and its wall clock is UTC, whatever the session's
    zone is.  With a UTC session the shift is nothing.
    """
    instant = c.cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(instant, F.current_timezone()) if naive else instant)
