"""The eleven input tables, derived by Spark from the given star-schema tables.

``FIXTURES.md`` describes every table. Only whole-number arithmetic and exact steps
are used, so ``checks/duck.py`` states the same tables for DuckDB. Every row of the
given tables goes in; the sizes grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.sources.warehouse import Warehouse

AS_OF = "2024-01-31 00:00:00"
STORAGE_AS_OF = "2001-10-15 00:00:00"


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Columns in the declared order and types; absent ones are NULL."""
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in schemas.ALL[table].items()
        ]
    )


def _numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _table_key(n: Column) -> tuple[Column, Column, Column]:
    return _numbered("proj-", n % 3), _numbered("ds_", n % 23), _numbered("tbl_", n % 1500)


def _ref(n: Column) -> Column:
    project, dataset, table = _table_key(n)
    return F.struct(
        project.alias("project_id"), dataset.alias("dataset_id"), table.alias("table_id")
    )


def _label(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def _add(ts: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(unit, n.cast("int"), ts)


def _second(ts: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(1_000_000)))


def keyed_jobs(events: DataFrame) -> DataFrame:
    """T1 with the event id it was made from."""
    e = F.col("event_id")
    created = F.col("ts").cast("timestamp")
    kind = (
        F.when(F.col("event_type") == "purchase", "LOAD")
        .when(F.col("event_type") == "signup", "EXTRACT")
        .otherwise("QUERY")
    )
    base = events.select(
        "event_id",
        "props",
        created.alias("creation_time"),
        _add(created, "SECOND", e % 45).alias("start0"),
        (F.lit(500) + (e * 7919) % 180000).alias("dur_ms"),
        _numbered("job_", F.when(e % 50 == 49, e - 1).otherwise(e)).alias("job_id"),
        F.concat(
            _numbered("user", F.col("user_id")),
            F.when(F.col("user_id") % 10 == 0, "-looker@acme-1.iam.gserviceaccount.com").otherwise(
                "@example.com"
            ),
        ).alias("user_email"),
        kind.alias("job_type"),
        (F.round(F.col("value") * 100).cast("bigint") * 10485760).alias("bytes0"),
    )
    start, dur = F.col("start0"), F.col("dur_ms")
    pending, unfinished = e % 97 == 0, (e % 97 == 0) | (e % 89 == 0)
    k1, k2 = e % 150, (e * 7) % 150
    query = F.col("job_type") == "QUERY"
    return base.select(
        "event_id",
        "job_id",
        "creation_time",
        "user_email",
        _numbered("proj-", e % 3).alias("project_id"),
        "job_type",
        F.when(e % 4 != 0, _numbered("admin:US.res-", e % 4)).alias("reservation_id"),
        F.when(e % 4 == 1, "STANDARD")
        .when(e % 4 == 2, "ENTERPRISE")
        .when(e % 8 == 3, "ENTERPRISE PLUS")
        .when(e % 8 == 7, "ENTERPRISE_PLUS")
        .alias("edition"),
        F.when(query & (e % 17 == 0), "SCRIPT").when(query, "SELECT").alias("statement_type"),
        F.when(~pending, start).alias("start_time"),
        F.when(~unfinished, _add(start, "MILLISECOND", dur)).alias("end_time"),
        F.when(pending, "PENDING").when(e % 89 == 0, "RUNNING").otherwise("DONE").alias("state"),
        F.when(e % 11 == 0, F.lit(0)).when(e % 23 != 0, F.col("bytes0")).alias("total_bytes_billed"),
        F.col("bytes0").alias("total_bytes_processed"),
        F.when(e % 31 != 0, dur * (1 + e % 700)).alias("total_slot_ms"),
        F.when(query, F.concat(F.lit("SELECT * FROM t WHERE props = "), "props")).alias("query"),
        _ref(k1).alias("destination_table"),
        F.slice(
            F.array(_ref(k1), _ref(k2)),
            1,
            F.when(e % 41 == 0, 0).when(e % 2 == 0, 1).otherwise(2),
        ).alias("referenced_tables"),
        F.slice(
            F.array(
                _label("team", _numbered("team-", e % 5)),
                _label(
                    "env",
                    F.when(e % 29 != 0, F.when(e % 2 == 0, "prod").otherwise("dev")),
                ),
            ),
            1,
            F.when(e % 4 == 0, 0).otherwise(2),
        ).alias("labels"),
    )


def jobs_timeline(jobs: DataFrame) -> DataFrame:
    """T2: a row per second a job ran, and per second it waited."""
    ran = F.col("end_time").isNotNull()
    first = _second(F.col("start_time"))
    running = jobs.filter(ran).withColumn(
        "ticks", F.timestamp_diff("SECOND", first, F.col("end_time")) + 1
    )
    slot_ms, ticks = F.col("total_slot_ms"), F.col("ticks")
    running = running.withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), ticks - 1)))
    share = F.call_function("div", slot_ms - slot_ms % ticks, ticks)
    waiting = jobs.withColumn("wait", F.col("event_id") % 45).withColumn(
        "n",
        F.explode(
            F.when(F.col("wait") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("wait") - 1))
        ),
    )

    e = F.col("event_id")
    error = F.when(
        e % 13 == 0,
        F.struct(
            F.lit("rateLimitExceeded").alias("reason"),
            _numbered("loc-", e % 7).alias("location"),
            F.when(e % 2 == 0, _numbered("quota ", e % 5)).alias("message"),
        ),
    )

    def rows(df: DataFrame, origin: Column, state: str, used: Column, error: Column) -> DataFrame:
        return df.select(
            _add(origin, "SECOND", F.col("n")).alias("period_start"),
            used.cast("bigint").alias("period_slot_ms"),
            "job_id",
            "project_id",
            "user_email",
            "job_type",
            "statement_type",
            F.when(F.col("event_id") % 19 == 0, "job_0").alias("parent_job_id"),
            "reservation_id",
            "edition",
            F.lit(state).alias("state"),
            F.col("creation_time").alias("job_creation_time"),
            F.col("start_time").alias("job_start_time"),
            F.col("end_time").alias("job_end_time"),
            "total_bytes_billed",
            error.alias("error_result"),
        )

    used = F.when(F.col("n") == 0, slot_ms % ticks).otherwise(0) + share
    none = F.lit(None)
    return rows(running, first, "RUNNING", used, none).unionByName(
        rows(waiting, _second(F.col("creation_time")), "PENDING", none, error)
    )


def reservations_timeline(jobs: DataFrame) -> DataFrame:
    """T3: a row per reservation and minute in which a job was created in it."""
    micros = F.unix_micros("creation_time")
    minutes = (
        jobs.filter(F.col("reservation_id").isNotNull())
        .groupBy(
            "reservation_id",
            F.timestamp_micros(micros - F.pmod(micros, F.lit(60_000_000))).alias("period_start"),
        )
        .agg(F.sum("event_id").alias("seed"))
        .withColumn("reservation_name", F.element_at(F.split("reservation_id", "[.]"), -1))
        .withColumn("r", F.element_at(F.split("reservation_name", "-"), -1).cast("bigint"))
    )

    def current(second: Column) -> Column:
        return F.lit(50) * ((F.col("seed") + second) % 5) * (F.col("r") - 1)

    most, assigned = F.lit(200) * (F.col("r") - 1), F.lit(100) * F.col("r")
    details = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint")),
        lambda s: F.struct(
            F.timestamp_micros(F.unix_micros("period_start") + s * 1_000_000).alias("start_time"),
            current(s).alias("autoscale_current_slots"),
            most.alias("autoscale_max_slots"),
            assigned.alias("slots_assigned"),
            F.lit(600).cast("bigint").alias("slots_max_assigned"),
        ),
    )
    return minutes.select(
        "period_start",
        "reservation_name",
        "reservation_id",
        F.when(F.col("r") == 1, "STANDARD")
        .when(F.col("r") == 2, "ENTERPRISE")
        .otherwise("ENTERPRISE_PLUS")
        .alias("edition"),
        assigned.alias("slots_assigned"),
        assigned.alias("slot_capacity"),
        # Over 60 seconds the five levels come up twelve times each.
        (F.lit(12 * 50 * 10) * (F.col("r") - 1)).alias("period_autoscale_slot_seconds"),
        F.struct(current(F.lit(0)).alias("current_slots"), most.alias("max_slots")).alias(
            "autoscale"
        ),
        details.alias("per_second_details"),
    )


def reservations(supplier: DataFrame) -> DataFrame:
    """T4: a reservation per supplier."""
    s = F.col("s_suppkey")
    return supplier.select(
        _numbered("res-", s).alias("reservation_name"),
        F.when(s % 3 == 1, "STANDARD")
        .when(s % 3 == 2, "ENTERPRISE")
        .otherwise("ENTERPRISE_PLUS")
        .alias("edition"),
    )


def capacity_commitments(supplier: DataFrame) -> DataFrame:
    """T5: a commitment per supplier; the standard edition has none."""
    s = F.col("s_suppkey")
    return supplier.select(
        F.when(s % 2 == 1, "ENTERPRISE").otherwise("ENTERPRISE_PLUS").alias("edition"),
        F.when(s % 5 == 2, "MONTHLY")
        .when(s % 5 == 4, "THREE_YEAR")
        .when(s % 5 == 1, "THREE_YEAR")
        .otherwise("ANNUAL")
        .alias("commitment_plan"),
        (F.lit(100) * (1 + s % 7)).alias("slot_count"),
        F.when(s % 6 == 5, "PENDING").otherwise("ACTIVE").alias("state"),
    )


def table_storage(part: DataFrame) -> DataFrame:
    """T6: a table per part."""
    p = F.col("p_partkey")
    project, dataset, table = _table_key(p)
    mib = 1048576
    al = (p * 7919 % 100000) * (4 * mib)
    ll = (p * 104729 % 100000) * (2 * mib)
    ap = (p * 7919 % 50000) * mib + (p % 40) * mib
    lp = (p * 104729 % 30000) * mib
    return part.select(
        project.alias("project_id"),
        dataset.alias("table_schema"),
        table.alias("table_name"),
        (p * 10).alias("total_rows"),
        (p % 31).alias("total_partitions"),
        (al + ll).alias("total_logical_bytes"),
        al.alias("active_logical_bytes"),
        ll.alias("long_term_logical_bytes"),
        (ap + lp).alias("total_physical_bytes"),
        ap.alias("active_physical_bytes"),
        lp.alias("long_term_physical_bytes"),
        ((p % 40) * mib).alias("time_travel_physical_bytes"),
        ((p % 25) * mib).alias("fail_safe_physical_bytes"),
        (p % 37 == 36).alias("deleted"),
    )


def tables(part: DataFrame) -> DataFrame:
    """T7: every part is a table; some have a name that storage does not know."""
    p = F.col("p_partkey")
    project, dataset, table = _table_key(p)
    return part.select(
        project.alias("table_catalog"),
        dataset.alias("table_schema"),
        F.when(p % 19 == 18, F.concat(table, F.lit("_new"))).otherwise(table).alias("table_name"),
        F.when(p % 13 == 12, "VIEW").otherwise("BASE TABLE").alias("table_type"),
    )


def schemata_options(part: DataFrame) -> DataFrame:
    """T8: two options per dataset, one of them its billing model for every other one."""
    n = F.col("n")
    datasets = part.select((F.col("p_partkey") % 23).alias("n")).distinct()
    model = F.struct(
        F.when(n % 2 == 0, "storage_billing_model").otherwise("default_collation"),
        F.when(n % 3 == 0, "PHYSICAL").otherwise("LOGICAL"),
    )
    expiry = F.struct(F.lit("default_table_expiration_days"), F.lit("30"))
    return datasets.select(
        _numbered("ds_", n).alias("schema_name"),
        F.inline(F.array(model, expiry)).alias("option_name", "option_value"),
    )


def table_options(part: DataFrame) -> DataFrame:
    """T9: an option per table, for some of them its billing model."""
    p = F.col("p_partkey")
    project, dataset, table = _table_key(p)
    return part.select(
        project.alias("table_catalog"),
        dataset.alias("table_schema"),
        table.alias("table_name"),
        F.when(p % 5 < 2, "storage_billing_model").otherwise("description").alias("option_name"),
        F.when(p % 5 == 0, "PHYSICAL").otherwise("LOGICAL").alias("option_value"),
    )


def table_storage_usage(lineitem: DataFrame) -> DataFrame:
    """T10: a usage row per line item."""
    q = F.col("l_quantity").cast("bigint") * 1000
    project, dataset, table = _table_key(F.col("l_partkey"))
    sizes = {
        "total_logical": 1610612736,
        "active_logical": 1073741824,
        "long_term_logical": 536870912,
        "total_physical": 402653184,
        "active_physical": 268435456,
        "long_term_physical": 134217728,
    }
    return lineitem.select(
        F.col("l_shipdate").cast("date").alias("usage_date"),
        project.alias("project_id"),
        dataset.alias("table_schema"),
        table.alias("table_name"),
        *[(q * size).alias(f"billable_{kind}_usage") for kind, size in sizes.items()],
    )


def audit_log(jobs: DataFrame) -> DataFrame:
    """T11: every T1 row as a nested event."""
    e = F.col("event_id")
    job_type = F.col("job_type")
    event = (
        F.when(e % 53 == 0, "table_copy_job_completed")
        .when(job_type == "QUERY", "query_job_completed")
        .when(job_type == "LOAD", "load_job_completed")
        .otherwise("extract_job_completed")
    )
    job_id = F.when(e % 67 != 0, F.when(e % 61 == 0, _numbered("script_job_", e)).otherwise(F.col("job_id")))

    def camel(ref: Column) -> Column:
        return F.struct(
            ref["project_id"].alias("projectId"),
            ref["dataset_id"].alias("datasetId"),
            ref["table_id"].alias("tableId"),
        )

    text = lambda ref: F.concat_ws(".", ref["project_id"], ref["dataset_id"], ref["table_id"])
    target = F.col("destination_table")
    config = F.struct(
        F.when(job_type == "QUERY", F.struct("query")).alias("query"),
        F.when(
            job_type == "LOAD",
            F.struct(
                F.array(F.concat(F.lit("gs://bucket/"), "job_id")).alias("sourceUris"),
                camel(target).alias("destinationTable"),
            ),
        ).alias("load"),
        F.when(job_type == "EXTRACT", F.struct(text(target).alias("sourceTable"))).alias("extract"),
        F.when(e % 53 == 0, F.struct(text(target).alias("destinationTable"))).alias("tableCopy"),
        F.when(e % 73 == 0, F.lit(True)).alias("dryRun"),
        F.when(e % 83 != 0, F.col("labels")).alias("labels"),
    )
    job = F.struct(
        F.struct(
            job_id.alias("jobId"),
            F.when(e % 2 == 0, "US").otherwise("EU").alias("location"),
            F.col("project_id").alias("projectId"),
        ).alias("jobName"),
        F.when(e % 79 != 0, config).alias("jobConfiguration"),
        F.struct(
            F.col("start_time").alias("startTime"),
            F.col("end_time").alias("endTime"),
            F.col("total_bytes_billed").alias("totalBilledBytes"),
            F.col("total_bytes_processed").alias("totalProcessedBytes"),
            F.col("total_slot_ms").alias("totalSlotMs"),
            F.transform("referenced_tables", camel).alias("referencedTables"),
        ).alias("jobStatistics"),
        F.col("labels"),
    )
    return jobs.select(
        F.coalesce("end_time", "creation_time").alias("timestamp"),
        F.struct(
            F.struct(
                F.when(e % 71 == 0, "").otherwise(F.col("user_email")).alias("principalEmail")
            ).alias("authenticationInfo"),
            F.struct(
                F.struct(event.alias("eventName"), job.alias("job")).alias("jobCompletedEvent")
            ).alias("servicedata_v1_bigquery"),
        ).alias("protopayload_auditlog"),
    )


# Per input table: the function that makes it and what it is made from.
DERIVATIONS = {
    "jobs": (lambda jobs: jobs, "jobs"),
    "jobs_timeline": (jobs_timeline, "jobs"),
    "reservations_timeline": (reservations_timeline, "jobs"),
    "reservations": (reservations, "supplier"),
    "capacity_commitments": (capacity_commitments, "supplier"),
    "table_storage": (table_storage, "part"),
    "tables": (tables, "part"),
    "schemata_options": (schemata_options, "part"),
    "table_options": (table_options, "part"),
    "table_storage_usage": (table_storage_usage, "lineitem"),
    "audit_log": (audit_log, "jobs"),
}


def derived_warehouse(spark: SparkSession, sf_dir: str, spread: int | None = None) -> Warehouse:
    """All tables; ``spread`` deals the one given event file out to that many tasks."""

    def resolve(table: str) -> DataFrame:
        make, source = DERIVATIONS[table]
        if source == "jobs":
            events = spark.read.parquet(f"{sf_dir}/events.parquet")
            given = keyed_jobs(events.repartition(spread) if spread else events)
        else:
            given = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return _conform(make(given), table)

    return Warehouse(spark, resolve)
