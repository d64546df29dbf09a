"""Time buckets, look-back bounds and time text. Instants are plain UTC timestamps.

Bucketing is integer arithmetic on microseconds, so it does not depend on the
session time zone and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.fixed_values import DEFAULT_TZ, UNIT_MS


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def truncate(ts: Column, unit: str, tz: str | None = None) -> Column:
    """Start of the ``unit`` that ``ts`` lies in, counted in ``tz`` (UTC if None).

    An hour or less never spans an offset change, so the time already elapsed in
    the local unit is taken off the instant itself; this keeps both passes of a
    repeated autumn hour apart. A day's start is found on the local clock.
    """
    step = UNIT_MS[unit] * 1000
    micros = F.unix_micros(ts)
    if tz is None or unit in ("minute", "second", "millisecond"):
        return from_micros(micros - F.pmod(micros, F.lit(step)))
    local = F.unix_micros(F.from_utc_timestamp(ts, tz))
    if unit == "hour":
        return from_micros(micros - F.pmod(local, F.lit(step)))
    return F.to_utc_timestamp(from_micros(local - F.pmod(local, F.lit(step))), tz)


def ceil_minute(ts: Column) -> Column:
    micros = F.unix_micros(ts)
    return from_micros(micros + F.pmod(-micros, F.lit(60_000_000)))


def civil_lookback(as_of: Column, days: int, tz: str = DEFAULT_TZ) -> Column:
    """``days`` back on the wall clock of ``tz`` (the same time of day, any offset)."""
    local = F.from_utc_timestamp(as_of, tz)
    return F.to_utc_timestamp(local - F.make_dt_interval(F.lit(days)), tz)


def civil(ts: Column, tz: str) -> Column:
    """The wall-clock date and time of an instant in ``tz``."""
    return F.from_utc_timestamp(ts, tz).cast("timestamp_ntz")


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Whole units from start to end, cut towards zero."""
    return F.timestamp_diff(unit.upper(), start, end)


def elapsed_ms(start: Column, end: Column) -> Column:
    return elapsed("millisecond", start, end)


def instant_text(ts: Column) -> Column:
    """``2024-01-30 08:00:00+00``, with 3 or 6 decimals only where they are needed."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(micros % 1000 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.lit("+00"),
    )
