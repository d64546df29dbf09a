"""Buckets, look-backs and grids, with both offset changes of a year."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.operators.timeseries import time_grid
from slotwise.params import instant
from tests.helpers import value

LA = "America/Los_Angeles"


def text(spark, column):
    return value(spark, column.cast("string"))


@pytest.mark.parametrize(
    "at, unit, expected",
    [
        # Spring: the clock goes from 02:00 to 03:00 at 10:00 UTC on 8 March.
        ("2026-03-08 09:30:00", "day", "2026-03-08 08:00:00"),
        ("2026-03-08 23:30:00", "day", "2026-03-08 08:00:00"),
        ("2026-03-09 07:30:00", "day", "2026-03-09 07:00:00"),
        ("2026-03-08 10:30:00", "hour", "2026-03-08 10:00:00"),
        # Autumn: 01:00 to 02:00 happens twice, at 08:00 and 09:00 UTC on 1 November.
        ("2026-11-01 08:30:00", "hour", "2026-11-01 08:00:00"),
        ("2026-11-01 09:30:00", "hour", "2026-11-01 09:00:00"),
        ("2026-11-02 07:30:00", "day", "2026-11-01 07:00:00"),
        ("2026-11-02 08:30:00", "day", "2026-11-02 08:00:00"),
        ("2026-11-01 09:30:15.25", "minute", "2026-11-01 09:30:00"),
        ("2026-11-01 09:30:15.25", "second", "2026-11-01 09:30:15"),
        ("1969-12-31 23:59:59.5", "second", "1969-12-31 23:59:59"),
    ],
)
def test_truncate_in_zone(spark, at, unit, expected):
    assert text(spark, times.truncate(instant(at), unit, LA)) == expected


def test_truncate_half_hour_zone(spark):
    assert text(spark, times.truncate(instant("2026-01-01 10:15"), "hour", "Asia/Kolkata")) == "2026-01-01 09:30:00"


def test_truncate_without_zone(spark):
    assert text(spark, times.truncate(instant("2026-03-08 23:30"), "day")) == "2026-03-08 00:00:00"


@pytest.mark.parametrize(
    "as_of, days, expected",
    [
        ("2026-03-10 12:00:00", 1, "2026-03-09 12:00:00"),
        ("2026-03-10 12:00:00", 7, "2026-03-03 13:00:00"),  # 05:00 both days, an hour apart in UTC
        ("2026-11-05 12:00:00", 7, "2026-10-29 11:00:00"),
    ],
)
def test_civil_lookback(spark, as_of, days, expected):
    assert text(spark, times.civil_lookback(instant(as_of), days, LA)) == expected


def test_ceil_minute(spark):
    assert text(spark, times.ceil_minute(instant("2024-01-01 00:00:00"))) == "2024-01-01 00:00:00"
    assert text(spark, times.ceil_minute(instant("2024-01-01 00:00:00.001"))) == "2024-01-01 00:01:00"


@pytest.mark.parametrize(
    "at, expected",
    [
        ("2024-01-30 08:00:00", "2024-01-30 08:00:00+00"),
        ("2024-01-30 08:00:00.25", "2024-01-30 08:00:00.250+00"),
        ("2024-01-30 08:00:00.19406", "2024-01-30 08:00:00.194060+00"),
    ],
)
def test_instant_text(spark, at, expected):
    assert value(spark, times.instant_text(instant(at))) == expected


def test_elapsed_cuts_towards_zero(spark):
    a, b = instant("2024-01-01 00:00:59.9"), instant("2024-01-01 00:01:00")
    assert value(spark, times.elapsed("minute", a, b)) == 0
    assert value(spark, times.elapsed_ms(a, b)) == 100


def test_aware_moments_are_turned_to_utc(spark):
    assert text(spark, instant("2024-01-01T00:00:00-08:00")) == "2024-01-01 08:00:00"


def ticks(df):
    return [r[0] for r in df.select(F.col("tick").cast("string")).orderBy("tick").collect()]


def test_day_grid_follows_the_calendar(spark):
    grid = time_grid(spark, "2026-03-10 12:00:00", timedelta(days=3), "day", LA)
    assert ticks(grid) == [
        "2026-03-07 08:00:00", "2026-03-08 08:00:00", "2026-03-09 07:00:00", "2026-03-10 07:00:00",
    ]


def test_literal_day_grid_drifts(spark):
    grid = time_grid(spark, "2026-03-10 12:00:00", timedelta(days=3), "day", LA, civil_days=False)
    assert ticks(grid)[-1] == "2026-03-10 08:00:00"


@pytest.mark.parametrize("unit, rows", [("day", 8), ("hour", 169), ("minute", 10_081), ("second", 604_801)])
def test_grid_sizes_of_a_week(spark, unit, rows):
    grid = time_grid(spark, "2024-01-31 00:00:00", timedelta(days=7), unit, LA)
    assert grid.count() == rows
