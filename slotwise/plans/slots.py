"""Average slots per time bucket, gap-filled over the look-back."""

from __future__ import annotations

from datetime import timedelta
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.fixed_values import DEFAULT_TZ, UNIT_MS
from slotwise.functions.times import civil, truncate
from slotwise.operators.scans import of_project, within_civil
from slotwise.operators.timeseries import gap_fill, gap_fill_keyed, time_grid
from slotwise.params import AsOf, days_before, instant
from slotwise.sources.warehouse import Warehouse


def slots_by(
    wh: Warehouse,
    unit: str,
    *,
    as_of: AsOf,
    days: int = 7,
    job_type: str | None = None,
    by_user: bool = False,
    include_null_type: bool = False,
    literal: bool = False,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Slot time per bucket over the bucket's length, 0 where nothing ran.

    Without ``job_type``, scripts are left out, as their children are counted; rows
    with no statement type (loads and others) go with them unless
    ``include_null_type``. ``literal`` spaces day buckets 24 hours apart, so that
    they miss the civil days after an offset change.
    """
    src = within_civil(of_project(wh.jobs_timeline, project_id), "period_start", as_of, days, tz)
    if job_type is not None:
        src = src.filter(F.col("job_type") == job_type)
    elif include_null_type:
        src = src.filter(F.col("statement_type").isNull() | (F.col("statement_type") != "SCRIPT"))
    else:
        src = src.filter(F.col("statement_type") != "SCRIPT")

    usage = "slotUsage" if unit == "second" else "slot_usage"
    user = ["user_email"] if by_user else []
    slots = F.sum("period_slot_ms") / F.lit(float(UNIT_MS[unit]))
    facts = src.groupBy(truncate(F.col("period_start"), unit, tz).alias("tick"), *user).agg(
        slots.alias(usage)
    )
    grid = time_grid(
        wh.spark, as_of, timedelta(days=days), unit, tz, civil_days=not literal
    )
    if by_user:
        lo = truncate(instant(days_before(as_of, days)), unit, tz)
        filled = gap_fill_keyed(grid, facts, "tick", lo, instant(as_of), [usage])
    else:
        filled = gap_fill(grid, facts, "tick", [usage])
    at = civil(F.col("tick"), tz).alias("timeInterval_PST")
    return filled.select(usage, *user, at).orderBy("timeInterval_PST", *user)


slots_by_day = partial(slots_by, unit="day")
slots_by_hour = partial(slots_by, unit="hour")
slots_by_minute = partial(slots_by, unit="minute")
slots_by_second = partial(slots_by, unit="second")
slots_by_minute_and_user = partial(slots_by, unit="minute", by_user=True)
load_slots_per_minute = partial(slots_by, unit="minute", job_type="LOAD")
load_slots_per_second = partial(slots_by, unit="second", job_type="LOAD")
query_slots_per_minute = partial(slots_by, unit="minute", job_type="QUERY")
query_slots_per_second = partial(slots_by, unit="second", job_type="QUERY")
query_slots_per_minute_and_user = partial(
    slots_by, unit="minute", job_type="QUERY", by_user=True
)
