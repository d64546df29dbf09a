"""Jobs running and queued at each minute, without matching jobs to minutes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.times import ceil_minute, truncate
from slotwise.operators.timeseries import time_grid
from slotwise.params import AsOf, instant, utc


def running_and_queued(jobs: DataFrame, as_of: AsOf, hours: int) -> DataFrame:
    """For each minute of the last ``hours``, jobs running and jobs waiting.

    A job runs from the later of its creation and start until its end, and waits
    from its creation until the earlier of start and end. Each of these spans is
    written as a change of +1 and one of -1 at the first minute at or after its
    ends; spans open before the grid count from its first minute. The changes are
    summed per minute, and only the grid, never the jobs, goes through the running
    sum: its rows are 60 an hour.
    """
    lookback = timedelta(hours=hours)
    grid = time_grid(jobs.sparkSession, as_of, lookback, "minute", name="minute")
    first = truncate(instant(utc(as_of) - lookback), "minute")
    last = truncate(instant(as_of), "minute")

    created, started, ended = (
        ceil_minute(F.col(c)) for c in ("creation_time", "start_time", "end_time")
    )
    run_from = F.when(started.isNotNull(), F.greatest(created, started))
    wait_to = F.least(started, ended)  # NULL, meaning never, only if both are

    def change(at, running: int, queued: int):
        return F.struct(
            F.greatest(at, first).alias("minute"),
            F.lit(running).alias("running"),
            F.lit(queued).alias("queued"),
        )

    spans = jobs.select(
        created.alias("c"), run_from.alias("r"), ended.alias("e"), wait_to.alias("w")
    )
    runs = F.col("r").isNotNull() & (F.col("e").isNull() | (F.col("r") < F.col("e")))
    waits = F.col("w").isNull() | (F.col("c") < F.col("w"))
    changes = (
        spans.select(
            F.explode(
                F.array(
                    F.when(runs, change(F.col("r"), 1, 0)),
                    F.when(runs & F.col("e").isNotNull(), change(F.col("e"), -1, 0)),
                    F.when(waits, change(F.col("c"), 0, 1)),
                    F.when(waits & F.col("w").isNotNull(), change(F.col("w"), 0, -1)),
                )
            ).alias("x")
        )
        .filter(F.col("x").isNotNull())
        .select("x.*")
        .filter(F.col("minute") <= last)
        .groupBy("minute")
        .agg(F.sum("running").alias("running"), F.sum("queued").alias("queued"))
    )
    so_far = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(changes, "minute", "left").select(
        "minute",
        F.coalesce(F.sum("running").over(so_far), F.lit(0)).alias("concurrent_running"),
        F.coalesce(F.sum("queued").over(so_far), F.lit(0)).alias("concurrent_queued"),
    )
