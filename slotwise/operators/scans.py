"""Look-back windows that reach the scan as plain range predicates."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.fixed_values import DEFAULT_TZ
from slotwise.functions.times import civil_lookback
from slotwise.params import AsOf, instant, utc
from slotwise.sources.layout import folder_of


def between(
    df: DataFrame,
    ts: str,
    lower: Column,
    upper: Column | None = None,
    *,
    strict: bool = False,
) -> DataFrame:
    """Rows with ``ts`` from ``lower`` (exclusive if ``strict``) up to ``upper``.

    The bounds fold to literals, so they are pushed to the files' statistics. A
    table laid out by day or month (see ``sources.layout``) carries ``<ts>_day`` or
    ``<ts>_month``; the same bounds are then put on that column too and whole folders
    are skipped.
    """
    kept = df.filter(F.col(ts) > lower if strict else F.col(ts) >= lower)
    if upper is not None:
        kept = kept.filter(F.col(ts) <= upper)
    for length in ("day", "month"):
        folder = f"{ts}_{length}"
        if folder in df.columns:
            kept = kept.filter(F.col(folder) >= folder_of(lower, length))
            if upper is not None:
                kept = kept.filter(F.col(folder) <= folder_of(upper, length))
    return kept


def within_civil(
    df: DataFrame, ts: str, as_of: AsOf, days: int, tz: str = DEFAULT_TZ
) -> DataFrame:
    """The last ``days`` on the wall clock of ``tz``, up to ``as_of``."""
    now = instant(as_of)
    return between(df, ts, civil_lookback(now, days, tz), now)


def within_absolute(
    df: DataFrame,
    ts: str,
    as_of: AsOf,
    *,
    days: int = 0,
    hours: int = 0,
    upper: bool = True,
    strict: bool = False,
) -> DataFrame:
    """The last ``days`` of exactly 24 hours (or ``hours``)."""
    lower = instant(utc(as_of) - timedelta(days=days, hours=hours))
    return between(df, ts, lower, instant(as_of) if upper else None, strict=strict)


def of_project(df: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of one project, or all of them; a plain test that is pushed to the files."""
    return df if project_id is None else df.filter(F.col("project_id") == project_id)


def _not_before(df: DataFrame, lower: Column) -> DataFrame:
    """Timeline rows from the second of ``lower`` on.

    A second of a job never lies before the second it was created in, so a lower
    bound on the creation is one on ``period_start`` too, which the table is laid
    out by. No row that the creation bound keeps is lost.
    """
    return between(df, "period_start", F.date_trunc("second", lower))


def created_within_civil(
    timeline: DataFrame, as_of: AsOf, days: int, tz: str = DEFAULT_TZ
) -> DataFrame:
    """Timeline rows of jobs created in the last ``days`` on the wall clock of ``tz``."""
    kept = within_civil(timeline, "job_creation_time", as_of, days, tz)
    return _not_before(kept, civil_lookback(instant(as_of), days, tz))


def created_within_absolute(
    timeline: DataFrame, as_of: AsOf, *, days: int, upper: bool = True, strict: bool = False
) -> DataFrame:
    """Timeline rows of jobs created in the last ``days`` of exactly 24 hours."""
    kept = within_absolute(
        timeline, "job_creation_time", as_of, days=days, upper=upper, strict=strict
    )
    return _not_before(kept, instant(utc(as_of) - timedelta(days=days)))


def since_utc_date(df: DataFrame, ts: str, as_of: AsOf, days: int) -> DataFrame:
    """From the UTC midnight ``days`` before the date of ``as_of``, without an end."""
    midnight = utc(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    return between(df, ts, instant(midnight - timedelta(days=days)))
