"""Time helpers: explicit ``as_of`` literals, range tokens, formatting."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashboard range tokens and their window length in days;
# any other token means 7 days.
RANGE_DAYS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}
DEFAULT_RANGE_DAYS = 7


def range_days(token: str | None) -> int:
    return RANGE_DAYS.get(token or "7d", DEFAULT_RANGE_DAYS)


def as_of_text(as_of) -> str:
    if isinstance(as_of, _dt.datetime):
        return as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(as_of, _dt.date):
        return as_of.strftime("%Y-%m-%d 00:00:00")
    return str(as_of)


def ts_lit(as_of) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of_text(as_of)).cast("timestamp_ntz")


def days(n) -> Column:
    """Day-time interval of ``n`` days (``n`` may be a column)."""
    return F.make_dt_interval(F.lit(n) if not isinstance(n, Column) else n)


def hours(n) -> Column:
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.make_dt_interval(F.lit(0), n)


def window_start(as_of, token: str | None) -> Column:
    """Lower bound of a rolling window; rows must be strictly after it."""
    return ts_lit(as_of) - days(range_days(token))


def iso_utc(c: Column) -> Column:
    """ISO-8601 text with milliseconds and a Z suffix; null stays null."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def add_months_overflow(ts: Column, n: Column) -> Column:
    """Month arithmetic that spills past the month end (31 Jan + 1 -> 2 Mar).

    Start of the month, plus ``n`` months, plus the original day offset and
    time of day, so a day that does not exist rolls into the next month.
    """
    month_start = F.date_trunc("month", ts).cast("timestamp_ntz")
    offset = ts - month_start
    shifted = F.add_months(F.to_date(month_start), n)
    return F.to_timestamp_ntz(F.date_format(shifted, "yyyy-MM-dd")) + offset
