"""The explicit clock: ``as_of`` replaces now()/current_date so results can be repeated."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: str | datetime | Column) -> Column:
    """``as_of`` as a timestamp column, read in the session time zone (UTC)."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(as_of, datetime) else as_of
    return F.to_timestamp(F.lit(text))


def day(as_of) -> Column:
    return F.to_date(instant(as_of))


def hours_before(as_of, hours: int) -> Column:
    """Rolling bound: ``as_of - hours``."""
    return instant(as_of) - F.make_dt_interval(hours=F.lit(int(hours)))


def days_before(as_of, days: int) -> Column:
    """Rolling bound: ``as_of - days``, to the microsecond."""
    return instant(as_of) - F.make_dt_interval(days=F.lit(int(days)))


def midnight_days_before(as_of, days: int) -> Column:
    """Midnight bound: start of the day ``days`` before the day of ``as_of``."""
    return F.date_sub(day(as_of), int(days)).cast("timestamp")
