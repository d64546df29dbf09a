"""Spreading, counting and filling, against brute force in plain Python."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from slotwise.operators import timeseries
from slotwise.operators.concurrency import running_and_queued
from slotwise.operators.timeseries import (
    alive_per_own_tick,
    alive_per_tick,
    expand_interval,
    gap_fill,
    gap_fill_keyed,
    time_grid,
)
from slotwise.params import instant

ZERO = datetime(2024, 1, 30, tzinfo=timezone.utc)
STEP = {"second": timedelta(seconds=1), "minute": timedelta(minutes=1), "hour": timedelta(hours=1)}


def floor(moment, unit):
    seconds = int(STEP[unit].total_seconds())
    since = (moment - ZERO) // STEP["second"]
    return ZERO + timedelta(seconds=since - since % seconds)


def intervals(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        start = ZERO + timedelta(seconds=rng.uniform(-7200, 90_000))
        end = start + timedelta(seconds=rng.uniform(-5, longest))
        rows.append((rng.choice("ab"), start, end, rng.randint(-5, 1000)))
    rows += [("a", None, ZERO, 1), ("a", ZERO, None, 1), ("b", ZERO, ZERO, 7)]
    return rows


SCHEMA = "k string, s timestamp, e timestamp, v bigint"


@pytest.mark.parametrize("unit, longest", [("second", 400), ("minute", 9000), ("hour", 200_000)])
def test_alive_per_tick_equals_unfolding(spark, unit, longest):
    rows = intervals(unit, 60, longest)
    expected = defaultdict(lambda: [0, 0])
    for key, start, end, measure in rows:
        if start is None or end is None:
            continue
        tick = floor(start, unit)
        while tick <= floor(end, unit):
            expected[(key, tick)][0] += 1
            expected[(key, tick)][1] += measure
            tick += STEP[unit]
    df = spark.createDataFrame(rows, SCHEMA)
    got = alive_per_tick(df, "s", "e", unit, name="t", keys=["k"], measure=F.col("v"))
    found = {
        (r.k, datetime.fromtimestamp(r.t, timezone.utc)): [r.alive, r.measure]
        for r in got.withColumn("t", F.unix_timestamp("t")).collect()
    }
    assert found == dict(expected)


def test_alive_per_tick_sees_few_changes_of_long_intervals(spark):
    """An interval costs two changes a day, not a row per tick."""
    df = spark.createDataFrame([("a", ZERO, ZERO + timedelta(days=3), 1)], SCHEMA)
    got = alive_per_tick(df, "s", "e", "second", name="t")
    assert got.count() == 3 * 86_400 + 1


@pytest.mark.parametrize("run_ticks", [3, 100_000])
@pytest.mark.parametrize("unit, longest", [("second", 400), ("minute", 9000), ("hour", 200_000)])
def test_own_ticks_equal_unfolding(spark, monkeypatch, unit, longest, run_ticks):
    """Ticks from each start, some starts with the same rest; runs of three ticks are cut and carried on."""
    monkeypatch.setattr(timeseries, "_RUN_TICKS", run_ticks)
    rows = intervals(unit, 40, longest)
    rows += [(None, ZERO + k * STEP[unit], ZERO + (3 * k + 9) * STEP[unit], k) for k in range(12)]
    rows += [("a", ZERO, ZERO + 2 * STEP[unit], 5), ("a", ZERO + 30 * STEP[unit], ZERO + 31 * STEP[unit], 5)]
    expected = defaultdict(lambda: [0, 0])
    for key, start, end, measure in rows:
        if start is None or end is None:
            continue
        tick = start
        while tick <= end:
            expected[(key, tick)][0] += 1
            expected[(key, tick)][1] += measure
            tick += STEP[unit]
    df = spark.createDataFrame(rows, SCHEMA)
    got = alive_per_own_tick(df, "s", "e", unit, name="t", keys=["k"], measure=F.col("v"))
    found = {(r.k, r.t.astimezone(timezone.utc)): [r.alive, r.measure] for r in got.collect()}
    assert found == dict(expected)


def test_own_ticks_of_a_month_come_from_two_changes(spark):
    """A 30-day job by the second: rows are made of levels, above the running sums only."""
    start = ZERO + timedelta(microseconds=123_456)
    df = spark.createDataFrame([("a", start, start + timedelta(days=30), 4)], SCHEMA)
    got = alive_per_own_tick(df, "s", "e", "second", name="t", measure=F.col("v"))
    ends = got.agg(F.count("*"), F.sum("measure"), F.unix_micros(F.min("t")), F.unix_micros(F.max("t"))).first()
    micros = [int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) for t in (start, start + timedelta(days=30))]
    assert list(ends) == [30 * 86_400 + 1, 4 * (30 * 86_400 + 1), *micros]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan[plan.index("Window") :]


@pytest.mark.parametrize("aligned, first", [(True, "2024-01-30 00:00:00"), (False, "2024-01-30 00:00:30")])
def test_expand_interval(spark, aligned, first):
    at = ZERO + timedelta(seconds=30)
    rows = [("a", at, at + timedelta(seconds=90), 1), ("b", at, at - timedelta(minutes=2), 1)]
    df = expand_interval(
        spark.createDataFrame(rows, SCHEMA), "s", "e", "minute", aligned=aligned, name="t"
    )
    got = [tuple(r) for r in df.select("k", F.col("t").cast("string")).orderBy("t").collect()]
    assert [k for k, _ in got] == ["a"] * (3 if aligned else 2)
    assert got[0][1] == first


def test_gap_fill(spark):
    grid = time_grid(spark, ZERO, timedelta(minutes=3), "minute")
    facts = spark.createDataFrame([(ZERO - timedelta(minutes=1), 2.0)], "tick timestamp, used double")
    rows = gap_fill(grid, facts, "tick", ["used"]).orderBy("tick").collect()
    assert [r.used for r in rows] == [0.0, 0.0, 2.0, 0.0]


def test_gap_fill_keyed_keeps_crowded_ticks_and_adds_empty_ones(spark):
    grid = time_grid(spark, ZERO, timedelta(minutes=2), "minute")
    at = ZERO - timedelta(minutes=1)
    facts = spark.createDataFrame(
        [(at, f"u{i}", 1.0) for i in range(50)] + [(at - timedelta(hours=1), "early", 1.0)],
        "tick timestamp, who string, used double",
    )
    lo = instant(ZERO - timedelta(minutes=2))
    rows = gap_fill_keyed(grid, facts, "tick", lo, instant(ZERO), ["used"]).collect()
    assert len(rows) == 52
    assert sorted(r.used for r in rows if r.who is None) == [0.0, 0.0]


def naive_concurrency(jobs, as_of, hours):
    """The definition: every job looked at for every minute."""
    out = {}
    tick = as_of - timedelta(hours=hours)
    while tick <= as_of:
        alive = [(c, s, e) for c, s, e in jobs if c <= tick and (e is None or e > tick)]
        running = sum(1 for _, s, _ in alive if s is not None and s <= tick)
        queued = sum(1 for _, s, _ in alive if s is None or s > tick)
        out[tick] = (running, queued)
        tick += STEP["minute"]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_and_queued_equals_the_definition(spark, seed):
    rng = random.Random(seed)
    jobs = []
    for _ in range(300):
        created = ZERO - timedelta(seconds=rng.uniform(-600, 3 * 3600))
        start = None if rng.random() < 0.1 else created + timedelta(seconds=rng.uniform(-90, 400))
        end = None if rng.random() < 0.1 else created + timedelta(seconds=rng.uniform(-90, 2000))
        if rng.random() < 0.2:
            created = floor(created, "minute")
        jobs.append((created, start, end))
    df = spark.createDataFrame(jobs, "creation_time timestamp, start_time timestamp, end_time timestamp")
    got = running_and_queued(df, ZERO, 2).withColumn("minute", F.unix_timestamp("minute")).collect()
    found = {
        datetime.fromtimestamp(r.minute, timezone.utc): (r.concurrent_running, r.concurrent_queued)
        for r in got
    }
    assert found == naive_concurrency(jobs, ZERO, 2)
    assert Counter(q >= 0 and r >= 0 for r, q in found.values()) == {True: 121}
