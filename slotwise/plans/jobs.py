"""Job lists and rollups over the job view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.functions.costs import (
    LADDER_BINARY,
    byte_ladder,
    in_unit,
    on_demand,
    or_zero,
    slot_rate,
    sum_bytes,
)
from slotwise.functions.times import elapsed, elapsed_ms
from slotwise.operators.dedupe import (
    JOB_ORDER,
    dearest_if_latest,
    dearest_job_per_text,
    descending,
    first_per_key,
    latest_jobs,
)
from slotwise.operators.repeats import runs_per_text
from slotwise.operators.scans import of_project, within_civil
from slotwise.operators.toplist import with_limit
from slotwise.params import AsOf, Prices
from slotwise.sources.warehouse import Warehouse

def _bytes() -> Column:
    return F.col("total_bytes_billed")


def _user() -> Column:
    return F.col("user_email").alias("user")


def _job_type() -> Column:
    return F.col("job_type").alias("jobType")


def _run() -> list[Column]:
    """Identity and times of a job under their report names."""
    names = {"job_id": "jobId", "project_id": "projectId", "start_time": "startTime", "end_time": "endTime"}
    return [F.col(c).alias(n) for c, n in names.items()]


def _slot_ms() -> Column:
    return F.col("total_slot_ms").alias("totalSlotMs")


def _approximate_slots():
    rate = slot_rate(F.col("total_slot_ms"), F.col("start_time"), F.col("end_time"))
    return F.round(rate, 2).alias("approximateSlotCount")


def _cost(price: float, name: str = "onDemandCost"):
    return F.round(on_demand(_bytes(), price), 2).alias(name)


def finished_jobs(
    wh: Warehouse,
    as_of: AsOf,
    days: int,
    job_type: str | None = None,
    tz: str = fv.DEFAULT_TZ,
    project_id: str | None = None,
) -> DataFrame:
    """Jobs created in the look-back that are done and have slot time."""
    jobs = within_civil(of_project(wh.jobs, project_id), "creation_time", as_of, days, tz)
    jobs = jobs.filter(F.col("total_slot_ms").isNotNull() & (F.col("state") == "DONE"))
    return jobs if job_type is None else jobs.filter(F.col("job_type") == job_type)


def general_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Every finished job with its billing type, bytes, cost and slots."""
    return latest_jobs(
        finished_jobs(wh, as_of, days, tz=tz, project_id=project_id), ["query"]
    ).select(
        _user(),
        _job_type(),
        F.col("reservation_id").alias("reservationId"),
        F.when(F.col("reservation_id").isNull(), "On-Demand")
        .otherwise("Editions")
        .alias("queryBillingType"),
        "query",
        *_run(),
        *byte_ladder(_bytes()),
        _slot_ms(),
        _cost(prices.on_demand),
        _approximate_slots(),
    )


def load_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Load jobs and their destinations (source URIs are not in the job view)."""
    target = F.col("destination_table")
    return latest_jobs(
        finished_jobs(wh, as_of, days, "LOAD", tz, project_id), ["query", "destination_table"]
    ).select(
        _user(),
        _job_type(),
        "query",
        *_run(),
        F.col("total_bytes_processed").alias("totalBytesProcessed"),
        F.lit(None).cast("string").alias("sourceUris"),
        target["project_id"].alias("destinationProjectId"),
        target["dataset_id"].alias("datasetId"),
        target["table_id"].alias("tableId"),
        _slot_ms(),
        _approximate_slots(),
    )


def query_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Query jobs with the tables they read and their labels."""
    return latest_jobs(
        finished_jobs(wh, as_of, days, "QUERY", tz, project_id), ["query", "referenced_tables", "labels"]
    ).select(
        _user(),
        "query",
        *_run(),
        F.col("referenced_tables").alias("referencedTables"),
        "labels",
        _cost(prices.on_demand),
        *byte_ladder(_bytes()),
        _slot_ms(),
        _approximate_slots(),
    )


def looker_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    account: str = fv.LOOKER_ACCOUNT,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Jobs of service accounts whose address matches ``account``."""
    jobs = finished_jobs(wh, as_of, days, tz=tz, project_id=project_id).filter(F.col("user_email").rlike(account))
    return latest_jobs(jobs, ["query"]).select(
        _user(),
        _job_type(),
        "query",
        *_run(),
        _bytes().alias("totalBytesBilled"),
        _slot_ms(),
        _cost(prices.on_demand_legacy, "cost"),
        _approximate_slots(),
    )


def _dearest_runs(jobs: DataFrame, literal: bool) -> DataFrame:
    """The dearest run of every text; see ``dearest_if_latest`` for ``literal``."""
    return dearest_if_latest(jobs) if literal else dearest_job_per_text(latest_jobs(jobs, ["query"]))


@with_limit()
def longest_running_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """The dearest run of every query text, longest first."""
    ran = (F.col("start_time"), F.col("end_time"))
    runs = _dearest_runs(finished_jobs(wh, as_of, days, "QUERY", tz, project_id), literal)
    return runs.select(
        _user(),
        "query",
        F.col("job_id").alias("jobId"),
        F.col("project_id").alias("projectId"),
        elapsed("second", *ran).alias("runningTimeInSeconds"),
        F.try_divide(elapsed_ms(*ran), _bytes()).alias("runtimeToBytesBilledRatio"),
        F.col("start_time").alias("startTime"),
        F.col("end_time").alias("endTime"),
        *byte_ladder(_bytes()),
        _cost(prices.on_demand_legacy, "cost"),
        _approximate_slots(),
    ).orderBy(F.col("runningTimeInSeconds").desc(), "jobId")


def _billed_list(runs: DataFrame, prices: Prices) -> DataFrame:
    return runs.select(
        _user(),
        "query",
        *_run(),
        *byte_ladder(_bytes(), LADDER_BINARY),
        _cost(prices.on_demand, "on_demand_cost"),
        _approximate_slots(),
    ).orderBy(F.col("on_demand_cost").desc(), "jobId")


@with_limit()
def top_billed_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Query jobs, dearest first."""
    return _billed_list(latest_jobs(
        finished_jobs(wh, as_of, days, "QUERY", tz, project_id), ["query"]
    ), prices)


@with_limit()
def top_billed_queries_deduplicated(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """The dearest run of every query text, dearest first."""
    return _billed_list(
        _dearest_runs(finished_jobs(wh, as_of, days, "QUERY", tz, project_id), literal), prices
    )


@with_limit()
def top_complex_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Query jobs by average slots, most first."""
    ran = (F.col("start_time"), F.col("end_time"))
    return (
        latest_jobs(
        finished_jobs(wh, as_of, days, "QUERY", tz, project_id), ["query"]
    )
        .select(
            _approximate_slots(),
            _user(),
            "query",
            *_run(),
            _bytes().alias("totalBytesBilled"),
            _cost(prices.on_demand),
            elapsed("second", *ran).alias("executionTime"),
            elapsed_ms(*ran).alias("executionTimeMs"),
        )
        .orderBy(F.col("approximateSlotCount").desc(), "jobId")
    )


@with_limit()
def top_cost_users(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """On-demand cost of each user's query jobs."""
    return (
        latest_jobs(finished_jobs(wh, as_of, days, "QUERY", tz, project_id))
        .groupBy(_user())
        .agg(sum_bytes(or_zero(_bytes())).alias("bytes"))
        .select("user", F.round(on_demand(F.col("bytes"), prices.on_demand), 2).alias("onDemandCost"))
        .orderBy(F.col("user").desc(), F.col("onDemandCost").desc())
    )


@with_limit()
def top_billed_labels(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Billed bytes and cost per label.

    Jobs are deduplicated and then unfolded into labels. ``literal`` unfolds first,
    which leaves each job one label only (the first by key and value).
    """
    jobs = finished_jobs(wh, as_of, days, tz=tz, project_id=project_id)
    named = F.col("labelKey").isNotNull() & F.col("labelValue").isNotNull()

    def unfold(df: DataFrame) -> DataFrame:
        return df.select(
            "job_id", *JOB_ORDER, F.inline("labels").alias("labelKey", "labelValue")
        ).filter(named)

    if literal:
        order = [*descending(JOB_ORDER), F.col("labelKey").asc(), F.col("labelValue").asc()]
        labelled = first_per_key(unfold(jobs), ["job_id"], order)
    else:
        labelled = unfold(latest_jobs(jobs, ["labels"]))
    total = F.col("bytes")
    return (
        labelled.groupBy("labelKey", "labelValue")
        .agg(sum_bytes(or_zero(_bytes())).alias("bytes"))
        .select(
            total.alias("totalBilledBytes"),
            *byte_ladder(total)[1:],
            F.round(on_demand(total, prices.on_demand), 2).alias("onDemandCost"),
            "labelKey",
            "labelValue",
        )
        .orderBy(F.col("onDemandCost").desc(), "labelKey", "labelValue")
    )


@with_limit(lambda: [F.col("tableIdCount").desc(), F.col("user"), F.col("projectId"), F.col("datasetId"), F.col("tableId")])
def table_query_counts(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """How often each user's jobs referenced each table, in any job state."""
    jobs = within_civil(of_project(wh.jobs, project_id), "creation_time", as_of, days, tz)
    jobs = latest_jobs(jobs.filter(F.col("total_slot_ms").isNotNull()), ["referenced_tables"])
    refs = jobs.select(
        _user(), F.inline("referenced_tables").alias("projectId", "datasetId", "tableId")
    )
    return refs.groupBy("user", "projectId", "datasetId", "tableId").agg(
        F.count("tableId").alias("tableIdCount")
    )


@with_limit()
def query_counts(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Runs and cost of every query text. ``literal`` counts ordered pairs of runs."""
    jobs = latest_jobs(
        finished_jobs(wh, as_of, days, "QUERY", tz, project_id), ["query"]
    )
    runs = F.col("runs").cast("decimal(19,0)") if literal else F.col("runs")
    total = F.col("bytes")
    return (
        runs_per_text(jobs, "query", _bytes())
        .select(
            "query",
            (runs * runs if literal else runs).alias("queryCount"),
            F.round(on_demand(total, prices.on_demand_legacy), 2).alias("onDemandCost"),
            *byte_ladder(total),
        )
        .orderBy(F.col("queryCount").desc(), "query")
    )


@with_limit()
def top_costly_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Query texts by the cost of all their runs.

    ``literal`` counts each run once for every other run of its text, and so leaves
    out texts that ran once.
    """
    jobs = latest_jobs(
        finished_jobs(wh, as_of, days, "QUERY", tz, project_id), ["query"]
    )
    return _costly(runs_per_text(jobs, "query", or_zero(_bytes())), prices.on_demand, literal)


def _costly(texts: DataFrame, price: float, literal: bool) -> DataFrame:
    runs = F.col("runs")
    if literal:
        # Counts of pairs pass 64 bits from three billion runs of a text on.
        others = (runs - 1).cast("decimal(19,0)")
        texts = texts.filter(runs > 1).withColumns(
            {"runs": runs.cast("decimal(19,0)") * others, "bytes": F.col("bytes") * others}
        )
    total = F.col("bytes")
    return texts.select(
        "query",
        runs.alias("queryCount"),
        *byte_ladder(total),
        F.round(in_unit(total, fv.TIB) * F.lit(price), 2).alias("onDemandCost"),
    ).orderBy(F.col("onDemandCost").desc(), "query")
