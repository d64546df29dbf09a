"""How many jobs run or wait at once."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.fixed_values import DEFAULT_TZ
from slotwise.functions.times import truncate
from slotwise.operators.concurrency import running_and_queued
from slotwise.operators.dedupe import first_per_key
from slotwise.operators.scans import created_within_civil, of_project, within_absolute
from slotwise.operators.sketches import distinct_sketch, estimated_distinct, merged_sketch
from slotwise.params import AsOf
from slotwise.sources.warehouse import Warehouse


def _alive(
    wh: Warehouse, as_of: AsOf, days: int, project_id: str | None, tz: str
) -> DataFrame:
    src = created_within_civil(of_project(wh.jobs_timeline, project_id), as_of, days, tz)
    return src.filter((F.col("job_type") == "QUERY") & F.col("parent_job_id").isNull())


def job_sketches(
    wh: Warehouse,
    unit: str,
    *,
    as_of: AsOf,
    days: int = 7,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Per bucket a sketch of the query jobs alive in it: period_start, jobs.

    Sketches can be stored and merged: ``rolled_up`` makes hours of minutes, and
    ``estimated_distinct`` tells how many jobs they hold, without the timeline.
    """
    bucket = truncate(F.col("period_start"), unit).alias("period_start")
    return _alive(wh, as_of, days, project_id, tz).groupBy(bucket).agg(distinct_sketch("job_id").alias("jobs"))


def rolled_up(sketches: DataFrame, unit: str) -> DataFrame:
    """Sketches of longer buckets from those of shorter ones."""
    bucket = truncate(F.col("period_start"), unit).alias("period_start")
    return sketches.groupBy(bucket).agg(merged_sketch("jobs").alias("jobs"))


def concurrent_queries_by(
    wh: Warehouse,
    unit: str,
    *,
    as_of: AsOf,
    days: int = 7,
    literal: bool = False,
    approximate: bool = False,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Query jobs alive in each bucket in which any was.

    ``literal`` keeps a single second of each job, the first of its newest creation.
    ``approximate`` counts by sketches (see ``job_sketches``) instead of exactly.
    """
    if approximate:
        if literal:
            raise ValueError("the published form counts rows, not distinct jobs")
        sketches = job_sketches(wh, unit, as_of=as_of, days=days, project_id=project_id, tz=tz)
        return estimated_distinct(sketches, "jobs", "job_count").orderBy("period_start")
    src = _alive(wh, as_of, days, project_id, tz)
    if literal:
        order = [F.col("job_creation_time").desc_nulls_last(), F.col("period_start").asc()]
        src = first_per_key(
            src.select("job_id", "job_creation_time", "period_start"), ["job_id"], order
        )
    bucket = truncate(F.col("period_start"), unit).alias("period_start")
    count = F.count("job_id") if literal else F.count_distinct("job_id")
    return src.groupBy(bucket).agg(count.alias("job_count")).orderBy("period_start")


concurrent_queries_by_millisecond = partial(concurrent_queries_by, unit="millisecond")
concurrent_queries_by_second = partial(concurrent_queries_by, unit="second")
concurrent_queries_by_minute = partial(concurrent_queries_by, unit="minute")


def concurrent_queued_and_running_jobs_per_minute(
    wh: Warehouse,
    *,
    as_of: AsOf,
    hours: int = 24,
    include_null_type: bool = False,
    project_id: str | None = None,
) -> DataFrame:
    """Query jobs running and queued at each minute of the last ``hours``.

    Jobs created up to an hour before the first minute are looked at too. Jobs with
    no statement type are left out with the scripts unless ``include_null_type``.
    """
    jobs = within_absolute(
        of_project(wh.jobs, project_id), "creation_time", as_of, hours=hours + 1, upper=False
    )
    typed = F.col("statement_type") != "SCRIPT"
    if include_null_type:
        typed = typed | F.col("statement_type").isNull()
    jobs = jobs.filter((F.col("job_type") == "QUERY") & typed)
    return running_and_queued(jobs, as_of, hours).orderBy(F.col("minute").desc())


def _queued(
    wh: Warehouse, as_of: AsOf, days: int, project_id: str | None, tz: str
) -> DataFrame:
    src = created_within_civil(of_project(wh.jobs_timeline, project_id), as_of, days, tz)
    return src.filter(F.col("state") == "PENDING")


def queued_jobs(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 1,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Each job waiting in each second, and its error: what is behind a busy second."""
    error = F.col("error_result")
    return (
        _queued(wh, as_of, days, project_id, tz)
        .select(
            "job_id",
            "period_start",
            "project_id",
            "user_email",
            "job_type",
            error["reason"].alias("error_reason"),
            error["location"].alias("error_location"),
            error["message"].alias("error_message"),
        )
        .distinct()
        .orderBy("period_start", "job_id")
    )


def queued_queries_by_second(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 1,
    approximate: bool = False,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Jobs of any type waiting in each second in which any was.

    ``approximate`` counts by sketches, with the error that ``operators.sketches`` states.
    """
    seconds = _queued(wh, as_of, days, project_id, tz).groupBy("period_start")
    if approximate:
        sketches = seconds.agg(distinct_sketch("job_id").alias("jobs"))
        return estimated_distinct(sketches, "jobs", "queued_jobs_cnt").orderBy("period_start")
    return seconds.agg(F.count_distinct("job_id").alias("queued_jobs_cnt")).orderBy("period_start")
