"""Reports over the nested audit log.

Each takes ``project_id``: one project, or None for all of them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.functions.costs import (
    byte_ladder,
    dbl,
    from_nano,
    nano_ratio,
    on_demand,
    or_zero,
    slot_rate,
    sum_bytes,
    sum_whole,
)
from slotwise.functions.times import elapsed, elapsed_ms
from slotwise.operators.audit import (
    bare_event_type,
    event_type,
    latest_events,
    recent_events,
    started_since,
    valid_events,
)
from slotwise.operators.dedupe import dearest_run_per_text
from slotwise.operators.repeats import attach_run_count, runs_per_text
from slotwise.operators.scans import within_absolute
from slotwise.operators.timeseries import alive_per_own_tick, alive_per_tick, expand_interval
from slotwise.operators.toplist import with_limit
from slotwise.params import AsOf, Prices
from slotwise.plans.jobs import _costly
from slotwise.sources.warehouse import Warehouse

def _bytes() -> Column:
    return F.col("totalBilledBytes")


def _billing_project() -> Column:
    return F.col("projectId").alias("billingProjectId")


def _ran() -> tuple[Column, Column]:
    return F.col("startTime"), F.col("endTime")


def _ran_ms() -> Column:
    return elapsed_ms(*_ran()).alias("executionTimeMs")


def _cost(price: float, per: int = fv.TIB) -> Column:
    return F.round(on_demand(or_zero(_bytes()), price, per), 2).alias("onDemandCost")


def _slots(literal: bool = False, digits: int | None = None) -> Column:
    """Average slots; ``literal`` has run time over slot time, its inverse."""
    rate = slot_rate(F.col("totalSlotMs"), *_ran(), inverted=literal)
    rate = rate if digits is None else F.round(rate, digits)
    return rate.alias("approximateSlotCount")


def _list_base(events: DataFrame, *tail: Column | str) -> DataFrame:
    config = F.col("config")
    return (
        latest_events(events, ["query"])
        .select(
            "user",
            event_type(F.col("eventName")).alias("eventType"),
            config["query"].alias("query"),
            config["load"].alias("load"),
            config["extract"].alias("extract"),
            config["tableCopy"].alias("tableCopy"),
            "timestamp",
            "jobId",
            "location",
            _billing_project(),
            "startTime",
            "endTime",
            *tail,
        )
        .orderBy("startTime", "jobId")
    )


def general_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Every finished job with its configuration, cost and slots."""
    events = recent_events(wh.audit_log, as_of, days, project_id=project_id)
    return _list_base(
        events,
        _cost(prices.on_demand_legacy).alias("cost"),
        or_zero(_bytes()).alias("totalBilledBytes"),
        "totalSlotMs",
        _ran_ms(),
        _slots(literal),
    )


def looker_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 5,
    project_id: str | None = None,
    account: str = fv.LOOKER_ACCOUNT,
    literal: bool = False,
) -> DataFrame:
    """Jobs of service accounts whose address matches ``account``."""
    events = recent_events(wh.audit_log, as_of, days, project_id=project_id)
    return _list_base(
        events.filter(F.col("user").rlike(account)),
        "totalBilledBytes",
        "totalSlotMs",
        _ran_ms(),
        _slots(literal),
    )


def jobs_in_regions(wh: Warehouse, *, as_of: AsOf, days: int = 7) -> DataFrame:
    """Log rows per project, location and job type."""
    log = within_absolute(wh.audit_log, "timestamp", as_of, days=days)
    events = valid_events(log, config=False, dry_run=False, project=False)
    return events.groupBy(
        F.col("projectId").alias("project_id"),
        "location",
        bare_event_type(F.col("eventName")).alias("job_type"),
    ).agg(F.count("*").alias("job_type_counter"))


def load_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 5,
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Load jobs with their sources, destination and slots."""
    events = recent_events(
        wh.audit_log, as_of, days, kind="load", project_id=project_id,
        config=False, dry_run=False, load=True,
    )
    target = F.col("config.load.destinationTable")
    return (
        latest_events(events)
        .select(
            F.col("user").alias("user_email"),
            "timestamp",
            "jobId",
            "location",
            _billing_project(),
            "startTime",
            "endTime",
            "totalProcessedBytes",
            F.col("config.load.sourceUris").alias("sourceUris"),
            target["projectId"].alias("destinationProjectId"),
            target["datasetId"].alias("destinationDatasetId"),
            target["tableId"].alias("destinationTabletId"),
            "totalSlotMs",
            _ran_ms(),
            _slots(literal),
        )
        .orderBy("startTime", "jobId")
    )


def query_job_information(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Query jobs with the tables they read and their labels.

    Labels are the configuration's, or else the job's; ``literal`` takes the job's.
    """
    events = recent_events(wh.audit_log, as_of, days, kind="query", project_id=project_id)
    labels = F.col("jobLabels") if literal else F.coalesce("config.labels", "jobLabels")
    return (
        latest_events(events)
        .select(
            "user",
            "jobId",
            "projectId",
            "startTime",
            "endTime",
            "referencedTables",
            labels.alias("labels"),
            _cost(prices.on_demand_legacy),
            *byte_ladder(_bytes()),
            "totalSlotMs",
            _slots(),
        )
        .orderBy("startTime", "jobId")
    )


@with_limit(lambda: [F.col("runningTimeInSeconds").desc(), F.col("jobId"), F.col("query")])
def longest_running_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 700,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """The dearest run of every text; ``literal`` looks at all log rows of a job."""
    events = recent_events(wh.audit_log, as_of, days, project_id=project_id)
    runs = events if literal else latest_events(events, ["query"])
    ties = [
        F.col("timestamp").desc_nulls_last(),
        F.col("jobId").asc(),
        F.col("totalSlotMs").desc_nulls_last(),
    ]
    return dearest_run_per_text(runs, "query", "totalBilledBytes", ties).select(
        "user",
        "jobId",
        "query",
        "projectId",
        elapsed("second", *_ran()).alias("runningTimeInSeconds"),
        F.try_divide(elapsed_ms(*_ran()), _bytes()).alias("runtimeToBytesBilledRatio"),
        "startTime",
        "endTime",
        _cost(prices.on_demand_legacy),
        *byte_ladder(_bytes()),
        _slots(),
    )


@with_limit()
def query_counts(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 700,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Runs and cost of every text.

    ``literal`` counts ordered pairs of all log rows of a text and, for a single
    project, charges the price of a TiB per GiB.
    """
    events = recent_events(wh.audit_log, as_of, days, project_id=project_id)
    texts = runs_per_text(latest_events(events, ["query"]), "query", or_zero(_bytes()))
    if literal:
        rows = events.filter(F.col("query").isNotNull()).groupBy("query")
        n = F.count("*").cast("decimal(19,0)")
        pairs = rows.agg((n * n).alias("pairs"))
        texts = texts.join(pairs, "query").withColumn("runs", F.col("pairs"))
    per = fv.GIB if literal and project_id is not None else fv.TIB
    total = F.col("bytes")
    return texts.select(
        "query",
        F.col("runs").alias("queryCount"),
        F.round(on_demand(total, prices.on_demand_legacy, per), 2).alias("onDemandCost"),
        *byte_ladder(total),
    ).orderBy(F.col("queryCount").desc(), "query")


@with_limit()
def top_costly_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 700,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Texts by the cost of all their runs; ``literal`` as in the job view's report."""
    events = recent_events(wh.audit_log, as_of, days, kind="query", project_id=project_id)
    texts = runs_per_text(latest_events(events, ["query"]), "query", or_zero(_bytes()))
    return _costly(texts, prices.on_demand_legacy, literal)


@with_limit(lambda: [F.col("jobCount").desc(), F.col("user"), F.col("projectId"), F.col("datasetId"), F.col("tableId")])
def table_query_counts(
    wh: Warehouse, *, as_of: AsOf, days: int = 700, project_id: str | None = None
) -> DataFrame:
    """How often each user's jobs referenced each table."""
    events = recent_events(wh.audit_log, as_of, days, project_id=project_id)
    refs = latest_events(events).select(
        "user", F.inline("referencedTables").alias("projectId", "datasetId", "tableId")
    )
    return refs.groupBy("user", "projectId", "datasetId", "tableId").agg(
        F.count("tableId").alias("jobCount")
    )


@with_limit()
def top_billed_labels(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Billed bytes and cost per label of the configuration, or else of the job.

    ``literal`` takes the configuration's only.
    """
    events = recent_events(wh.audit_log, as_of, days, project_id=project_id)
    labels = F.col("config.labels") if literal else F.coalesce("config.labels", "jobLabels")
    total = F.col("bytes")
    _, mib, _, tib = byte_ladder(total)
    return (
        latest_events(events)
        .select("totalBilledBytes", F.inline(labels).alias("labelKey", "labelValue"))
        .filter(F.col("labelKey").isNotNull() & F.col("labelValue").isNotNull())
        .groupBy("labelKey", "labelValue")
        .agg(sum_bytes(or_zero(_bytes())).alias("bytes"))
        .select(
            "labelKey",
            "labelValue",
            total.alias("totalBilledBytes"),
            mib,
            tib,
            F.round(on_demand(total, prices.on_demand_legacy), 2).alias("onDemandCost"),
        )
        .orderBy(F.col("onDemandCost").desc(), "labelKey", "labelValue")
    )


def _billed_queries(wh: Warehouse, as_of: AsOf, days: int, project_id: str | None, **tests):
    return recent_events(
        wh.audit_log, as_of, days, kind="query", project_id=project_id,
        config=False, query_text=True, billed=True, **tests,
    )


def _billed_columns(price: float, per: int = fv.TIB) -> list[Column | str]:
    return [
        "user",
        "timestamp",
        "jobId",
        "location",
        _billing_project(),
        "startTime",
        "endTime",
        _cost(price, per),
        *byte_ladder(_bytes()),
        "totalBilledBytes",
        "query",
    ]


@with_limit()
def top_billed_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Log rows of query jobs, most bytes first, dry runs included.

    ``literal`` charges the price of a TiB per GiB for a single project.
    """
    per = fv.GIB if literal and project_id is not None else fv.TIB
    events = _billed_queries(wh, as_of, days, project_id, dry_run=False)
    return events.select(*_billed_columns(prices.on_demand_legacy, per)).orderBy(
        F.col("totalBilledBytes").desc(), "jobId", "timestamp"
    )


@with_limit()
def top_billed_queries_deduplicated(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
) -> DataFrame:
    """Query jobs with known slots, most bytes first, dry runs included."""
    events = latest_events(_billed_queries(wh, as_of, days, project_id, dry_run=False), ["query"])
    return (
        events.select(*_billed_columns(prices.on_demand_legacy), _slots(digits=2))
        .filter(F.col("approximateSlotCount").isNotNull())
        .orderBy(F.col("totalBilledBytes").desc(), "jobId")
    )


@with_limit()
def top_complex_queries(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 5,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
) -> DataFrame:
    """Query jobs by average slots, most first."""
    events = recent_events(wh.audit_log, as_of, days, kind="query", project_id=project_id)
    cost = F.round(on_demand(_bytes(), prices.on_demand_legacy), 2).alias("onDemandCost")
    return (
        latest_events(events, ["query"])
        .select(
            _slots(digits=2),
            "user",
            "query",
            "jobId",
            "location",
            _billing_project(),
            "startTime",
            "endTime",
            "totalBilledBytes",
            cost,
            "totalSlotMs",
            _ran_ms(),
        )
        .filter(F.col("approximateSlotCount").isNotNull())
        .orderBy(F.col("approximateSlotCount").desc(), "jobId")
    )


def _cost_by(events: DataFrame, keys: list[Column | str], price: float, per: int) -> DataFrame:
    """Sum of the jobs' costs in whole cents, leaving out jobs that round to none."""
    cents = F.round(on_demand(_bytes(), price, per), 2).cast("decimal(18,2)")
    return (
        latest_events(events)
        .select(*keys, cents.alias("cents"))
        .filter(F.col("cents") > 0)
        .groupBy(*[k if isinstance(k, str) else "billingProjectId" for k in keys])
        .agg(dbl(F.sum("cents")).alias("onDemandCost"))
    )


@with_limit()
def top_cost_users(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 5,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
) -> DataFrame:
    """Cost of each user's query jobs."""
    events = recent_events(wh.audit_log, as_of, days, kind="query", project_id=project_id)
    return _cost_by(events, ["user"], prices.on_demand_legacy, fv.TIB).orderBy(
        F.col("user").desc(), F.col("onDemandCost").desc()
    )


@with_limit()
def top_cost_user_by_region_and_project(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 5,
    prices: Prices = Prices.us(),
    literal: bool = False,
) -> DataFrame:
    """Cost of query jobs per user, location and project.

    ``literal`` charges the price of a TiB per GiB.
    """
    events = recent_events(wh.audit_log, as_of, days, kind="query")
    per = fv.GIB if literal else fv.TIB
    keys = ["user", "location", _billing_project()]
    return _cost_by(events, keys, prices.on_demand_legacy, per).orderBy(
        F.col("user").desc(), F.col("onDemandCost").desc(), "location", "billingProjectId"
    )


def slot_usage_by_billing_project_and_project(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    start_within_days: int | None = 1,
    literal: bool = False,
) -> DataFrame:
    """Summed average slots per billing project and referenced table.

    ``literal`` sums run time over slot time, the inverse.
    """
    events = recent_events(
        wh.audit_log, as_of, days, kind="query",
        config=False, project=False, query_text=True, billed=True,
    )
    jobs = latest_events(started_since(events, as_of, start_within_days))
    slot_ms, ran = F.col("totalSlotMs"), elapsed_ms(*_ran())
    nano = nano_ratio(ran, slot_ms) if literal else nano_ratio(slot_ms, ran)
    return (
        jobs.select(
            _billing_project(),
            nano.alias("nano"),
            F.inline("referencedTables").alias("projectId", "datasetId", "tableId"),
        )
        .groupBy("billingProjectId", "projectId", "datasetId", "tableId")
        .agg(F.round(from_nano(sum_whole(F.col("nano"))), 2).alias("slotUsage"))
        .orderBy(
            F.col("slotUsage").desc(), "billingProjectId", "projectId", "datasetId", "tableId"
        )
    )


def concurrent_queries_by(
    wh: Warehouse,
    unit: str,
    *,
    as_of: AsOf,
    days: int = 7,
    start_within_days: int | None = 1,
    project_id: str | None = None,
) -> DataFrame:
    """Log rows of query jobs alive in each bucket in which any was."""
    events = recent_events(
        wh.audit_log, as_of, days, kind="query", project_id=project_id, config=False
    )
    events = started_since(events, as_of, start_within_days)
    ticks = alive_per_tick(events, "startTime", "endTime", unit, name=unit)
    return ticks.select(F.col("alive").alias("jobCounter"), unit).orderBy(unit)


def slots_by(
    wh: Warehouse,
    unit: str,
    *,
    as_of: AsOf,
    kind: str | None = None,
    by_user: bool = False,
    days: int = 7,
    start_within_days: int | None = 1,
    project_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Summed average slots of the jobs alive in each bucket, by event type.

    ``literal`` counts a job's ticks from its own start, so that ticks of different
    jobs rarely meet.
    """
    events = recent_events(
        wh.audit_log, as_of, days, kind=kind, project_id=project_id, config=False
    )
    jobs = latest_events(started_since(events, as_of, start_within_days)).select(
        "user",
        event_type(F.col("eventName")).alias("eventType"),
        "startTime",
        "endTime",
        nano_ratio(F.col("totalSlotMs"), elapsed_ms(*_ran())).alias("nano"),
    )
    jobs = jobs.filter(F.col("nano").isNotNull())
    keys = ["user", "eventType"] if by_user else ["eventType"]
    if literal:
        ticks = alive_per_own_tick(
            jobs, "startTime", "endTime", unit, name=unit, keys=keys, measure=F.col("nano")
        )
    elif unit in ("hour", "day"):
        # Few ticks per job: one row each, summed map-side.
        ticks = (
            expand_interval(jobs, "startTime", "endTime", unit, aligned=True, name=unit)
            .groupBy(unit, *keys)
            .agg(sum_whole(F.col("nano")).alias("measure"))
        )
    else:
        ticks = alive_per_tick(
            jobs, "startTime", "endTime", unit, name=unit, keys=keys, measure=F.col("nano")
        )
    return ticks.select(unit, *keys, from_nano(F.col("measure")).alias("slotCount")).orderBy(
        unit, *keys
    )


concurrent_queries_by_minute = partial(concurrent_queries_by, unit="minute")
concurrent_queries_by_second = partial(concurrent_queries_by, unit="second")
slots_by_day = partial(slots_by, unit="day")
slots_by_hour = partial(slots_by, unit="hour")
slots_by_minute = partial(slots_by, unit="minute")
slots_by_second = partial(slots_by, unit="second")
slots_by_minute_and_user = partial(slots_by, unit="minute", by_user=True)
load_slots_per_minute = partial(slots_by, unit="minute", kind="load")
load_slots_per_second = partial(slots_by, unit="second", kind="load")
query_slots_per_minute = partial(slots_by, unit="minute", kind="query")
query_slots_per_second = partial(slots_by, unit="second", kind="query")


def billing_recommendations_per_query(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
) -> DataFrame:
    """On-demand or flat-rate for each run, by weighted scores.

    The weights are fixed values: cost, job type, run time, slots and repetition.
    """
    events = recent_events(wh.audit_log, as_of, days, kind="query", project_id=project_id)
    runs = events.select(
        "query",
        "projectId",
        "jobId",
        "timestamp",
        "startTime",
        "endTime",
        _slots(),
        _cost(prices.on_demand_legacy),
        *byte_ladder(_bytes()),
        event_type(F.col("eventName")).alias("eventType"),
        _ran_ms(),
    )
    counted = attach_run_count(runs, "query", "queryCount")
    cost, count = F.col("onDemandCost"), F.col("queryCount")

    def points(test: Column, either: tuple[float, float]) -> Column:
        return F.when(test, F.lit(either[0])).otherwise(F.lit(either[1]))

    kind, slots = F.col("eventType"), F.col("approximateSlotCount")
    long = F.col("executionTimeMs") > fv.LONG_RUN_MS
    demand = (
        cost * fv.DEMAND_PER_COST
        + points(kind == "QUERY", fv.DEMAND_IF_QUERY)
        + points(long, fv.DEMAND_IF_LONG)
        + points(slots > fv.DEMAND_MANY_SLOTS, fv.DEMAND_IF_MANY_SLOTS)
        + count * cost * F.lit(fv.DEMAND_PER_REPEATED_COST)
        + points(kind.isin("LOAD", "TABLE COPY", "EXTRACT"), fv.DEMAND_IF_OTHER_KIND)
    )
    flat = (
        cost * fv.FLAT_PER_COST
        + points(kind == "QUERY", fv.FLAT_IF_QUERY)
        + points(long, fv.FLAT_IF_LONG)
        + points(slots > fv.FLAT_MANY_SLOTS, fv.FLAT_IF_MANY_SLOTS)
        + count * F.lit(fv.FLAT_PER_REPEATED_COST) * cost
    )
    demand_wins = F.col("demand") > F.col("flat")
    ratio = F.when(demand_wins, F.try_divide("demand", "flat")).otherwise(
        F.try_divide("flat", "demand")
    )
    return (
        counted.withColumns({"demand": demand, "flat": flat})
        .orderBy(
            cost.desc(), slots.desc(), "jobId", "timestamp"
        )
        .select(
            "query",
            F.when(demand_wins, "On Demand").otherwise("Flat Rate").alias("recommendedBilling"),
            F.round(ratio, 2).alias("recommendedBillingRatio"),
            "projectId",
            "startTime",
            "endTime",
            "approximateSlotCount",
            "onDemandCost",
            "totalBytesBilled",
            "totalMegabytesBilled",
            "totalGigabytesBilled",
            "totalTerabytesBilled",
        )
    )
