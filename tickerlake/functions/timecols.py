"""Time columns. All jobs run with session time zone UTC (see session.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# date_trunc units accepted by per-ticker views; n-minute grains use window().
TRUNC_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def event_at(ms: Column) -> Column:
    """Epoch milliseconds -> naive UTC timestamp."""
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def truncate(unit: str, ts: Column) -> Column:
    """date_trunc that stays a naive timestamp (date_trunc returns a zoned one)."""
    if unit not in TRUNC_UNITS:
        raise ValueError(f"unsupported grain {unit!r}; use one of {TRUNC_UNITS} or 'N minutes'")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def bucket(grain: str, ts: Column) -> Column:
    """Bucket start for a grain: a date_trunc unit or 'N minutes' (e.g. '5 minutes')."""
    g = grain.strip().lower()
    if g in TRUNC_UNITS:
        return truncate(g, ts)
    parts = g.split()
    if len(parts) == 2 and parts[0].isdigit() and parts[1] in ("minute", "minutes"):
        # Tumbling window start; window() works on naive timestamps and keeps the type.
        return F.window(ts, f"{int(parts[0])} minutes").start.cast("timestamp_ntz")
    raise ValueError(f"unsupported grain {grain!r}")


def dt_of(ms: Column) -> Column:
    """UTC date partition value of an epoch-ms column."""
    return F.to_date(F.timestamp_millis(ms))


def hr_of(ms: Column) -> Column:
    """UTC two-digit hour partition value of an epoch-ms column."""
    return F.date_format(F.timestamp_millis(ms), "HH")
