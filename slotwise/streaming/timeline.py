"""The slot report kept up to date from a stream of timeline rows.

Batch reports answer for a fixed window; here, in append mode, each bucket is issued
once, when the watermark has passed it. The bucket and the slot arithmetic are the batch report's.
Buckets without rows are not issued: a stream has no grid to fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.fixed_values import DEFAULT_TZ, UNIT_MS
from slotwise.functions.times import civil


def slots_by_stream(
    timeline: DataFrame,
    unit: str = "minute",
    *,
    delay: str = "10 minutes",
    job_type: str | None = None,
    by_user: bool = False,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Average slots per closed bucket of a second, minute or hour.

    A row sent again within ``delay`` counts once; one later than ``delay`` is
    dropped. State is one sum per open bucket, and one key per row of the delay.
    """
    if unit not in ("second", "minute", "hour"):
        raise ValueError(f"a stream is bucketed by second, minute or hour, not {unit}")
    rows = (
        timeline.filter(
            F.col("statement_type") != "SCRIPT" if job_type is None else F.col("job_type") == job_type
        )
        .withWatermark("period_start", delay)
        .dropDuplicatesWithinWatermark(["job_id", "period_start", "state"])
    )
    user = ["user_email"] if by_user else []
    summed = rows.groupBy(F.window("period_start", f"1 {unit}"), *user).agg(
        (F.sum("period_slot_ms") / F.lit(float(UNIT_MS[unit]))).alias("slot_usage")
    )
    return summed.select(
        F.coalesce("slot_usage", F.lit(0.0)).alias("slot_usage"),
        *user,
        civil(F.col("window.start"), tz).alias("timeInterval_PST"),
    )
