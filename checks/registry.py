"""Every report under its name, run over the derived tables with its default window.

``name`` gives the corrected answer and ``name__literal`` the published one where
the two differ. Audit reports are named ``audit_<name>`` for one project and
``audit_<name>_general`` for all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import duck_reports
from checks.derive import AS_OF, STORAGE_AS_OF, derived_warehouse
from checks.duck_reports import PROJECT, RESERVATION, WITHOUT_PROJECT
from slotwise.params import utc_session
from slotwise.plans import audit, billing, concurrency, jobs, reservations, slots, storage
from slotwise.sources.warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]
Report = Callable[..., DataFrame]


def leaves_text(value: Column, kind: T.DataType) -> Column:
    """A nested value as text with every leaf, NULL told apart; lists of jobs are sorted."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: leaves_text(x, kind.elementType))
        if isinstance(kind.elementType, T.StructType) and "job_id" in kind.elementType.names:
            items = F.array_sort(items)
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [leaves_text(value[f.name], f.dataType) for f in kind]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        if isinstance(kind, T.DoubleType):
            value = value.cast("decimal(28,6)")
        elif isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        text = F.concat(F.lit("'"), value.cast("string"), F.lit("'"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("NULL"))


def portable(df: DataFrame) -> DataFrame:
    """The same rows in types every engine has: no zones, decimals or nesting."""
    columns = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.DateType)):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, T.DecimalType):
            c = c.cast("double" if kind.scale else "bigint")
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            c = leaves_text(c, kind)
        columns.append(c.alias(field.name))
    return df.select(*columns)


# Reports with a time window at AS_OF, and whether a literal variant exists.
_TIMED: dict[str, tuple[Report, bool]] = {
    "autoscale_usage_and_costs_per_second": (
        reservations.autoscale_usage_and_costs_per_second, True),
    "billing_recommendation_per_query": (billing.billing_recommendation_per_query, True),
    "bqe_slot_utilization_by_minute": (
        partial(reservations.bqe_slot_utilization_by_minute, reservation_name=RESERVATION), True),
    "concurrent_queries_by_millisecond": (concurrency.concurrent_queries_by_millisecond, True),
    "concurrent_queries_by_minute": (concurrency.concurrent_queries_by_minute, True),
    "concurrent_queries_by_second": (concurrency.concurrent_queries_by_second, True),
    "concurrent_queued_and_running_jobs_per_minute": (
        concurrency.concurrent_queued_and_running_jobs_per_minute, False),
    "costs_by_query": (billing.costs_by_query, True),
    "general_job_information": (jobs.general_job_information, False),
    "load_job_information": (jobs.load_job_information, False),
    "load_slots_per_minute": (slots.load_slots_per_minute, False),
    "load_slots_per_second": (slots.load_slots_per_second, False),
    "longest_running_queries": (jobs.longest_running_queries, True),
    "looker_job_information": (jobs.looker_job_information, False),
    "queries_and_reservation_usage_per_second": (
        reservations.queries_and_reservation_usage_per_second, True),
    "query_counts": (jobs.query_counts, True),
    "query_job_information": (jobs.query_job_information, False),
    "query_slots_per_minute": (slots.query_slots_per_minute, False),
    "query_slots_per_minute_and_user": (slots.query_slots_per_minute_and_user, False),
    "query_slots_per_second": (slots.query_slots_per_second, False),
    "queued_jobs": (concurrency.queued_jobs, False),
    "queued_queries_by_second": (concurrency.queued_queries_by_second, False),
    "reservation_cost_per_day": (reservations.reservation_cost_per_day, True),
    "slots_by_day": (slots.slots_by_day, False),
    "slots_by_hour": (slots.slots_by_hour, False),
    "slots_by_minute": (slots.slots_by_minute, False),
    "slots_by_minute_and_user": (slots.slots_by_minute_and_user, False),
    "slots_by_second": (slots.slots_by_second, False),
    "table_query_counts": (jobs.table_query_counts, False),
    "table_storage_by_most_recently_queried": (
        storage.table_storage_by_most_recently_queried, False),
    "top_billed_labels": (jobs.top_billed_labels, True),
    "top_billed_queries": (jobs.top_billed_queries, False),
    "top_billed_queries_deduplicated": (jobs.top_billed_queries_deduplicated, True),
    "top_complex_queries": (jobs.top_complex_queries, False),
    "top_cost_users": (jobs.top_cost_users, False),
    "top_costly_queries": (jobs.top_costly_queries, True),
    "total_billing_recommendation": (billing.total_billing_recommendation, True),
}

# Storage snapshots, without a time window.
_SNAPSHOTS: dict[str, Report] = {
    "project_per_table_storage_model_recommendations":
        storage.project_per_table_storage_model_recommendations,
    "project_storage_model_recommendation": storage.project_storage_model_recommendation,
}

# Audit reports for one project or all, and whether a literal variant exists.
_AUDIT: dict[str, tuple[Report, bool]] = {
    "billing_recommendations_per_query": (audit.billing_recommendations_per_query, False),
    "concurrent_queries_by_minute": (audit.concurrent_queries_by_minute, False),
    "concurrent_queries_by_second": (audit.concurrent_queries_by_second, False),
    "general_job_information": (audit.general_job_information, True),
    "load_job_information": (audit.load_job_information, True),
    "load_slots_per_minute": (audit.load_slots_per_minute, False),
    "load_slots_per_second": (audit.load_slots_per_second, False),
    "longest_running_queries": (audit.longest_running_queries, True),
    "looker_job_information": (audit.looker_job_information, True),
    "query_counts": (audit.query_counts, True),
    "query_job_information": (audit.query_job_information, True),
    "query_slots_per_minute": (audit.query_slots_per_minute, False),
    "query_slots_per_second": (audit.query_slots_per_second, False),
    "slots_by_day": (audit.slots_by_day, True),
    "slots_by_hour": (audit.slots_by_hour, True),
    "slots_by_minute": (audit.slots_by_minute, True),
    "slots_by_minute_and_user": (audit.slots_by_minute_and_user, False),
    "slots_by_second": (audit.slots_by_second, True),
    "table_query_counts": (audit.table_query_counts, False),
    "top_billed_labels": (audit.top_billed_labels, True),
    "top_billed_queries": (audit.top_billed_queries, True),
    "top_billed_queries_deduplicated": (audit.top_billed_queries_deduplicated, False),
    "top_complex_queries": (audit.top_complex_queries, False),
    "top_cost_users": (audit.top_cost_users, False),
    "top_costly_queries": (audit.top_costly_queries, True),
}

# Audit reports that exist for all projects only.
_AUDIT_ALL: dict[str, tuple[Report, bool]] = {
    "jobs_in_regions": (audit.jobs_in_regions, False),
    "slot_usage_by_billing_project_and_project": (
        audit.slot_usage_by_billing_project_and_project, True),
    "top_cost_user_by_region_and_project": (audit.top_cost_user_by_region_and_project, True),
}


# Lists cut to their first rows: the reports that take a limit.
_LISTS = [*duck_reports.FIRST_ROWS]

# Further forms by a flag: sketches instead of exact counts, and rows without a statement type.
_FLAGS = {
    "approximate": (
        "concurrent_queries_by_millisecond", "concurrent_queries_by_second", "concurrent_queries_by_minute",
        "queued_queries_by_second",
    ),
    "include_null_type": (
        "slots_by_day", "slots_by_hour", "slots_by_minute", "slots_by_minute_and_user",
        "concurrent_queued_and_running_jobs_per_minute",
    ),
}


def flat(name: str, df: DataFrame) -> DataFrame:
    """A report's rows as they are compared."""
    return portable(df)


# The derived tables' plans by session and folder. Only the plans are kept, no data.
_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}


def _shared(spark: SparkSession, sf_dir: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, sf_dir)
    held = _WAREHOUSES.get(key)
    if held is None or held.spark is not spark:
        held = _WAREHOUSES[key] = derived_warehouse(spark, sf_dir)
    utc_session(spark)
    return held


def reports() -> dict[str, Callable[[Warehouse], DataFrame]]:
    """Each report with its parameters bound, as it is: nested, zoned and sorted."""
    out: dict[str, Callable[[Warehouse], DataFrame]] = {}

    def add(name: str, report: Report, literal: bool, **arguments) -> None:
        out[name] = partial(report, **arguments)
        if literal:
            out[f"{name}__literal"] = partial(report, **arguments, literal=True)

    for name, (report, literal) in _TIMED.items():
        add(name, report, literal, as_of=AS_OF)
        if name not in WITHOUT_PROJECT:
            add(f"{name}__project", report, False, as_of=AS_OF, project_id=PROJECT)
    for name, report in _SNAPSHOTS.items():
        add(name, report, True)
    add("table_usage_and_costs_per_day", storage.table_usage_and_costs_per_day, False,
        as_of=STORAGE_AS_OF)
    for name, (report, literal) in _AUDIT.items():
        add(f"audit_{name}", report, literal, as_of=AS_OF, project_id=PROJECT)
        add(f"audit_{name}_general", report, literal, as_of=AS_OF, project_id=None)
    for name, (report, literal) in _AUDIT_ALL.items():
        add(f"audit_{name}", report, literal, as_of=AS_OF)
    for name in _LISTS:
        out[f"{name}__limit"] = partial(out[name], limit=duck_reports.LIMIT)
    for flag, names in _FLAGS.items():
        for name in names:
            out[f"{name}__{flag}"] = partial(out[name], **{flag: True})
    return out


def queries() -> dict[str, Query]:
    """Each report over the tables derived from a data folder, in portable types."""

    def query(name: str, report: Callable[[Warehouse], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(name, report(_shared(spark, sf_dir)))

        return run

    return {name: query(name, report) for name, report in reports().items()}
