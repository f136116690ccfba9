"""Epoch time helpers (F3, P12, P15, P16). The session time zone is UTC."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted review times are 1995-01-01 .. 2030-01-01 in epoch
# seconds; anything above 4e9 is taken as milliseconds.
MIN_TIME = 788918400
MAX_TIME = 1893456000
MILLIS_ABOVE = 4000000000

# Month short names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Whole epoch seconds of a timestamp or timestamp_ntz (UTC wall clock)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def to_ts(epoch) -> Column:
    return F.timestamp_seconds(_c(epoch))


def valid_time(time="Time") -> Column:
    """Inclusive range filter on raw epoch seconds (pushes to the scan)."""
    return _c(time).between(MIN_TIME, MAX_TIME)


def normalise_time(time="Time") -> Column:
    """Ms -> s repair, then range check; NULL when out of range."""
    t = _c(time).cast("long")
    secs = F.when(t > MILLIS_ABOVE, F.call_function("div", t, F.lit(1000))).otherwise(t)
    return F.when(secs.between(MIN_TIME, MAX_TIME), secs)


def usable_time(time="Time") -> Column:
    """Range predicate on the raw value that keeps every row ``normalise_time``
    can use (seconds in range, or milliseconds whose seconds are in range).
    Plain ranges on the stored column, so Parquet can skip row groups."""
    t = _c(time)
    return t.between(MIN_TIME, MAX_TIME) | t.between(MIN_TIME * 1000, MAX_TIME * 1000 + 999)


def display_date(time="Time") -> Column:
    """Yyyy-MM-dd of the repaired time, '' when unusable."""
    secs = normalise_time(time)
    return F.coalesce(F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd"), F.lit(""))


def in_year(year: int, time="Time") -> Column:
    """Half-open [y-01-01, y+1-01-01) on epoch seconds (range predicate, pushes down)."""
    lo = int(_dt.datetime(year, 1, 1, tzinfo=_dt.timezone.utc).timestamp())
    hi = int(_dt.datetime(year + 1, 1, 1, tzinfo=_dt.timezone.utc).timestamp())
    t = _c(time)
    return (t >= lo) & (t < hi)


def in_year_raw(year: int, time="Time") -> Column:
    """P16 on the stored value: the raw ``Time`` values whose repaired time
    (``normalise_time``) falls in ``year`` -- the year's range in seconds, or the
    same range in milliseconds. Plain ranges on the stored column, so Parquet
    can skip row groups; exact, because inside the valid years a seconds value
    is never above the millisecond threshold and a milliseconds value always is.
    """
    lo = int(_dt.datetime(year, 1, 1, tzinfo=_dt.timezone.utc).timestamp())
    hi = int(_dt.datetime(year + 1, 1, 1, tzinfo=_dt.timezone.utc).timestamp())
    if not (hi <= MILLIS_ABOVE < lo * 1000):
        return F.lit(True)   # outside the valid years: leave it to the exact check on _t
    t = _c(time)
    return ((t >= lo) & (t < hi)) | ((t >= lo * 1000) & (t < hi * 1000))


def iso_timestamp(ts) -> Column:
    """P20: ISO-8601 text with microseconds (always six digits)."""
    return F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
