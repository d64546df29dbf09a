"""Time grids, gap filling and spreading intervals over ticks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.fixed_values import UNIT_MS
from slotwise.functions.costs import sum_whole
from slotwise.functions.times import from_micros, truncate
from slotwise.params import AsOf, instant, utc

_DAY_US = UNIT_MS["day"] * 1000


def time_grid(
    spark: SparkSession,
    as_of: AsOf,
    lookback: timedelta,
    unit: str,
    tz: str | None = None,
    *,
    civil_days: bool = True,
    name: str = "tick",
) -> DataFrame:
    """Every bucket start from ``as_of - lookback`` to ``as_of``, both ends included.

    Its size is the look-back over the unit, whatever the data holds. ``range``
    builds it in parallel. Days follow the local calendar unless ``civil_days`` is
    off, in which case they are 24 hours apart and drift at an offset change.
    """
    first = truncate(instant(utc(as_of) - lookback), unit, tz)
    if unit == "day" and civil_days and tz is not None:
        local = [
            F.to_date(F.from_utc_timestamp(t, tz)) for t in (first, instant(as_of))
        ]
        days = spark.range(1).select(F.explode(F.sequence(*local)).alias("_d"))
        return days.select(F.to_utc_timestamp(F.col("_d").cast("timestamp"), tz).alias(name))
    steps = lookback // timedelta(milliseconds=UNIT_MS[unit])
    micros = F.unix_micros(first) + F.col("id") * F.lit(UNIT_MS[unit] * 1000)
    return spark.range(steps + 1).select(from_micros(micros).alias(name))


def gap_fill(grid: DataFrame, facts: DataFrame, tick: str, zeros: Sequence[str]) -> DataFrame:
    """Facts with at most one row per tick, on every tick of the grid."""
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in zeros}
    return grid.join(facts, tick, "left").withColumns(filled)


def gap_fill_keyed(
    grid: DataFrame, facts: DataFrame, tick: str, lo: Column, hi: Column, zeros: Sequence[str]
) -> DataFrame:
    """Facts with any number of rows per tick, plus a row for each empty tick.

    The facts pass through without a join, so a crowded tick is never gathered in
    one task; only the list of ticks that occur meets the grid.
    """
    inside = facts.filter(F.col(tick).between(lo, hi))
    empty = grid.join(inside.select(tick).distinct(), tick, "left_anti")
    return inside.unionByName(empty, allowMissingColumns=True).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in zeros}
    )


def expand_interval(
    df: DataFrame, start: str, end: str, unit: str, *, aligned: bool, name: str
) -> DataFrame:
    """One row per tick from ``start`` to ``end``; none if the interval is reversed.

    Ticks are bucket starts if ``aligned``, else whole units counted from ``start``.
    """
    step = F.lit(UNIT_MS[unit] * 1000)
    first = F.unix_micros(truncate(F.col(start), unit) if aligned else F.col(start))
    count = F.call_function("div", F.unix_micros(F.col(end)) - first, step)
    ticks = F.when(
        F.unix_micros(F.col(end)) >= first, F.sequence(F.lit(0).cast("bigint"), count)
    )
    return (
        df.withColumn("_first", first)
        .withColumn("_tick", F.explode(ticks))
        .withColumn(name, from_micros(F.col("_first") + F.col("_tick") * step))
        .drop("_first", "_tick")
    )


def _tick_index(ts: Column, step_us: int) -> Column:
    micros = F.unix_micros(ts)
    return F.call_function("div", micros - F.pmod(micros, F.lit(step_us)), F.lit(step_us))


def alive_per_tick(
    df: DataFrame,
    start: str,
    end: str,
    unit: str,
    *,
    name: str,
    keys: Sequence[str] = (),
    measure: Column | None = None,
) -> DataFrame:
    """Per aligned tick and key, how many intervals touch it and their summed measure.

    An interval becomes an opening and a closing change instead of a row per tick,
    so its cost does not grow with its length. Changes are summed map-side, and a
    running sum per day and key sees at most one row per tick. Intervals are cut at
    midnight, which makes the days independent and the sum parallel. The measure is
    a whole number, which keeps additions and removals exact.
    """
    step_us = UNIT_MS[unit] * 1000
    per_day = _DAY_US // step_us
    value = F.lit(0).cast("bigint") if measure is None else measure
    spans = (
        df.select(
            *keys,
            value.alias("_v"),
            _tick_index(F.col(start), step_us).alias("_a"),
            (_tick_index(F.col(end), step_us) + 1).alias("_b"),
        )
        .filter(F.col("_a") < F.col("_b"))
        .withColumn(
            "_day",
            F.explode(
                F.sequence(
                    F.expr(f"(_a - pmod(_a, {per_day})) div {per_day}"),
                    F.expr(f"(_b - 1 - pmod(_b - 1, {per_day})) div {per_day}"),
                )
            ),
        )
    )
    opened = F.greatest(F.col("_a"), F.col("_day") * per_day)
    closed = F.least(F.col("_b"), (F.col("_day") + 1) * per_day)
    one = F.lit(1).cast("bigint")
    changes = (
        spans.select(
            *keys,
            "_day",
            F.inline(
                F.array(
                    F.struct(opened.alias("_i"), one.alias("_n"), F.col("_v").alias("_s")),
                    F.struct(closed.alias("_i"), (-one).alias("_n"), (-F.col("_v")).alias("_s")),
                )
            ),
        )
        .groupBy(*keys, "_day", "_i")
        .agg(F.sum("_n").alias("_n"), sum_whole(F.col("_s")).alias("_s"))
    )
    order = Window.partitionBy(*keys, "_day").orderBy("_i")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = changes.select(
        *keys,
        "_i",
        F.sum("_n").over(running).alias("alive"),
        F.sum("_s").over(running).alias("measure"),
        F.lead("_i").over(order).alias("_next"),
    ).filter(F.col("alive") > 0)
    return levels.select(
        *keys,
        "alive",
        "measure",
        F.explode(F.sequence(F.col("_i"), F.col("_next") - 1)).alias("_i"),
    ).select(*keys, "alive", "measure", from_micros(F.col("_i") * step_us).alias(name))


# Ticks of one running sum: its rows are one task's work, and a longer level is cut there.
_RUN_TICKS = 100_000


def alive_per_own_tick(
    df: DataFrame,
    start: str,
    end: str,
    unit: str,
    *,
    name: str,
    keys: Sequence[str] = (),
    measure: Column | None = None,
) -> DataFrame:
    """The same for ticks that each interval counts from its own start.

    Intervals whose starts leave the same rest by the unit share their ticks, others
    never do: the rest is a further key. An interval is an opening and a closing
    change whatever its length; no row is made of an interval and a tick or day.
    Running sums go over stretches of ``_RUN_TICKS`` ticks in parallel. What is alive
    where a stretch begins comes from the sums of the stretches before it, as one
    more change at its first tick. Rows appear only where levels turn into ticks.
    """
    step_us = UNIT_MS[unit] * 1000
    value = F.lit(0).cast("bigint") if measure is None else measure
    one = F.lit(1).cast("bigint")
    since = F.unix_micros(F.col(start))
    spans = df.select(
        *keys,
        value.alias("_v"),
        F.pmod(since, F.lit(step_us)).alias("_rest"),
        _tick_index(F.col(start), step_us).alias("_a"),
        F.call_function("div", F.unix_micros(F.col(end)) - since, F.lit(step_us)).alias("_more"),
    ).filter(F.unix_micros(F.col(end)) >= since)
    by = [*keys, "_rest"]
    stretch = F.expr(f"(_i - pmod(_i, {_RUN_TICKS})) div {_RUN_TICKS}").alias("_run")
    changes = (
        spans.select(
            *by,
            F.inline(
                F.array(
                    F.struct(F.col("_a").alias("_i"), one.alias("_n"), F.col("_v").alias("_s")),
                    F.struct(
                        (F.col("_a") + F.col("_more") + 1).alias("_i"),
                        (-one).alias("_n"),
                        (-F.col("_v")).alias("_s"),
                    ),
                )
            ),
        )
        .groupBy(*by, stretch, "_i")
        .agg(F.sum("_n").alias("_n"), sum_whole(F.col("_s")).alias("_s"))
    )
    runs = Window.partitionBy(*by).orderBy("_run")
    before = runs.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        changes.groupBy(*by, "_run")
        .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        .select(
            *by,
            "_run",
            (F.col("_run") * _RUN_TICKS).alias("_i"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"),
            (F.lead("_run").over(runs) * _RUN_TICKS).alias("_until"),
        )
    )
    order = Window.partitionBy(*by, "_run").orderBy("_i")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = (
        changes.withColumn("_until", F.lit(None).cast("bigint"))
        .unionByName(carried)
        .select(
            *by,
            "_i",
            F.sum("_n").over(running).alias("alive"),
            F.sum("_s").over(running).alias("measure"),
            F.coalesce(F.lead("_i").over(order), F.max("_until").over(Window.partitionBy(*by, "_run"))).alias("_next"),
        )
        .filter((F.col("alive") > 0) & (F.col("_i") < F.col("_next")))
    )
    cut = levels.withColumn("_at", F.explode(F.sequence(F.col("_i"), F.col("_next") - 1, F.lit(_RUN_TICKS).cast("bigint"))))
    ticks = F.sequence(F.col("_at"), F.least(F.col("_at") + _RUN_TICKS, F.col("_next")) - 1)
    return cut.select(*by, "alive", "measure", F.explode(ticks).alias("_i")).select(
        *keys, "alive", "measure", from_micros(F.col("_i") * step_us + F.col("_rest")).alias(name)
    )
