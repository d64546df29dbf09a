"""The nested audit log as flat job rows.

Only the nested fields a report selects are read from the files: the flattening
is a projection of paths, which Spark prunes down to the leaves used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.operators.dedupe import descending, first_per_key, tie_hash
from slotwise.operators.scans import since_utc_date
from slotwise.params import AsOf

_EVENT = "protopayload_auditlog.servicedata_v1_bigquery.jobCompletedEvent"

# Flat name of each nested field.
_FIELDS = {
    "user": "protopayload_auditlog.authenticationInfo.principalEmail",
    "eventName": f"{_EVENT}.eventName",
    "jobId": f"{_EVENT}.job.jobName.jobId",
    "location": f"{_EVENT}.job.jobName.location",
    "projectId": f"{_EVENT}.job.jobName.projectId",
    "config": f"{_EVENT}.job.jobConfiguration",
    "startTime": f"{_EVENT}.job.jobStatistics.startTime",
    "endTime": f"{_EVENT}.job.jobStatistics.endTime",
    "totalBilledBytes": f"{_EVENT}.job.jobStatistics.totalBilledBytes",
    "totalProcessedBytes": f"{_EVENT}.job.jobStatistics.totalProcessedBytes",
    "totalSlotMs": f"{_EVENT}.job.jobStatistics.totalSlotMs",
    "referencedTables": f"{_EVENT}.job.jobStatistics.referencedTables",
    "jobLabels": f"{_EVENT}.job.labels",
}

EVENT_ORDER = (
    "timestamp", "endTime", "startTime", "totalSlotMs", "totalBilledBytes", "eventName"
)


def event_type(event_name: Column) -> Column:
    chain = F
    for name, kind in fv.EVENT_TYPES.items():
        chain = chain.when(event_name == name, F.lit(kind))
    return chain


def bare_event_type(event_name: Column) -> Column:
    return F.upper(F.replace(event_name, F.lit(fv.EVENT_SUFFIX), F.lit("")))


def flatten(log: DataFrame) -> DataFrame:
    fields = [F.col(path).alias(name) for name, path in _FIELDS.items()]
    return log.select("timestamp", *fields)


def valid_events(
    log: DataFrame,
    *,
    kind: str | None = None,
    project_id: str | None = None,
    config: bool = True,
    dry_run: bool = True,
    project: bool = True,
    query_text: bool = False,
    billed: bool = False,
    load: bool = False,
) -> DataFrame:
    """Flat rows of real, finished jobs.

    Always required: a job id that is not a script child's, a completion event
    (of ``kind`` query or load, if given) and a user. The flags require a job
    configuration, no dry run, a project, a query text, billed bytes and a load
    configuration; ``project_id`` keeps one project.
    """
    flat = flatten(log)
    event = F.col("eventName")
    tests = [
        F.col("jobId").isNotNull(),
        ~F.col("jobId").like(fv.SCRIPT_CHILD_LIKE),
        event.like(f"%{fv.EVENT_SUFFIX}") if kind is None else event == f"{kind}{fv.EVENT_SUFFIX}",
        F.col("user").isNotNull() & (F.col("user") != ""),
    ]
    if config:
        tests.append(F.col("config").isNotNull())
    if dry_run:
        tests.append(F.col("config.dryRun").isNull())
    if project:
        tests.append(F.col("projectId").isNotNull())
    if query_text:
        tests.append(F.col("config.query.query").isNotNull())
    if billed:
        tests.append(F.col("totalBilledBytes").isNotNull())
    if load:
        tests.append(F.col("config.load").isNotNull())
    if project_id is not None:
        tests.append(F.col("projectId") == project_id)
    for test in tests:
        flat = flat.filter(test)
    return flat.withColumn("query", F.col("config.query.query"))


def recent_events(log: DataFrame, as_of: AsOf, days: int, **tests) -> DataFrame:
    """Valid events logged from the UTC date ``days`` before ``as_of``."""
    return valid_events(since_utc_date(log, "timestamp", as_of, days), **tests)


def started_since(events: DataFrame, as_of: AsOf, days: int | None) -> DataFrame:
    """Events of jobs started from the UTC date ``days`` before ``as_of``."""
    if days is None:
        return events
    return since_utc_date(events, "startTime", as_of, days)


def latest_events(events: DataFrame, reads: Sequence[str] = ()) -> DataFrame:
    """One row per job id: the version logged last.

    Versions equal in the whole order are told apart by a hash, which takes in the
    wide columns (``reads``) that the report shows.
    """
    narrow = ("user", "location", "projectId", "totalProcessedBytes")
    order = [*descending(EVENT_ORDER), tie_hash(events, narrow, reads).asc()]
    return first_per_key(events, ["jobId"], order)
