"""Columns and types of the eleven input tables."""

from __future__ import annotations

_REF = "struct<project_id: string, dataset_id: string, table_id: string>"
_AUDIT_REF = "struct<projectId: string, datasetId: string, tableId: string>"
_LABELS = "array<struct<key: string, value: string>>"
_SECOND = (
    "struct<start_time: timestamp, autoscale_current_slots: bigint, autoscale_max_slots: bigint, "
    "slots_assigned: bigint, slots_max_assigned: bigint>"
)

_AUDIT_CONFIG = (
    "struct<query: struct<query: string>, "
    f"load: struct<sourceUris: array<string>, destinationTable: {_AUDIT_REF}>, "
    "extract: struct<sourceTable: string>, tableCopy: struct<destinationTable: string>, "
    f"dryRun: boolean, labels: {_LABELS}>"
)
_AUDIT_STATISTICS = (
    "struct<startTime: timestamp, endTime: timestamp, totalBilledBytes: bigint, "
    f"totalProcessedBytes: bigint, totalSlotMs: bigint, referencedTables: array<{_AUDIT_REF}>>"
)
_AUDIT_JOB = (
    "struct<jobName: struct<jobId: string, location: string, projectId: string>, "
    f"jobConfiguration: {_AUDIT_CONFIG}, jobStatistics: {_AUDIT_STATISTICS}, labels: {_LABELS}>"
)
_AUDIT_PAYLOAD = (
    "struct<authenticationInfo: struct<principalEmail: string>, servicedata_v1_bigquery: "
    f"struct<jobCompletedEvent: struct<eventName: string, job: {_AUDIT_JOB}>>>"
)


def _columns(kind: str, names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), kind)


ALL: dict[str, dict[str, str]] = {
    "jobs": {
        **_columns("timestamp", "creation_time start_time end_time"),
        **_columns(
            "string",
            "job_id user_email project_id job_type statement_type state reservation_id edition query",
        ),
        **_columns("bigint", "total_bytes_billed total_bytes_processed total_slot_ms"),
        "destination_table": _REF,
        "referenced_tables": f"array<{_REF}>",
        "labels": _LABELS,
    },
    "jobs_timeline": {
        **_columns("timestamp", "period_start job_creation_time job_start_time job_end_time"),
        **_columns("bigint", "period_slot_ms total_bytes_billed"),
        **_columns(
            "string",
            "job_id project_id user_email job_type statement_type parent_job_id "
            "reservation_id edition state",
        ),
        "error_result": "struct<reason: string, location: string, message: string>",
    },
    "reservations_timeline": {
        "period_start": "timestamp",
        **_columns("string", "reservation_name reservation_id edition"),
        **_columns("bigint", "slots_assigned slot_capacity period_autoscale_slot_seconds"),
        "autoscale": "struct<current_slots: bigint, max_slots: bigint>",
        "per_second_details": f"array<{_SECOND}>",
    },
    "reservations": _columns("string", "reservation_name edition"),
    "capacity_commitments": {
        **_columns("string", "edition commitment_plan state"),
        "slot_count": "bigint",
    },
    "table_storage": {
        **_columns("string", "project_id table_schema table_name"),
        **_columns(
            "bigint",
            "total_rows total_partitions total_logical_bytes active_logical_bytes "
            "long_term_logical_bytes total_physical_bytes active_physical_bytes "
            "long_term_physical_bytes time_travel_physical_bytes fail_safe_physical_bytes",
        ),
        "deleted": "boolean",
    },
    "tables": _columns("string", "table_catalog table_schema table_name table_type"),
    "schemata_options": _columns("string", "schema_name option_name option_value"),
    "table_options": _columns(
        "string", "table_catalog table_schema table_name option_name option_value"
    ),
    "table_storage_usage": {
        "usage_date": "date",
        **_columns("string", "project_id table_schema table_name"),
        **_columns(
            "bigint",
            "billable_total_logical_usage billable_active_logical_usage "
            "billable_long_term_logical_usage billable_total_physical_usage "
            "billable_active_physical_usage billable_long_term_physical_usage",
        ),
    },
    "audit_log": {"timestamp": "timestamp", "protopayload_auditlog": _AUDIT_PAYLOAD},
}


def ddl(table: str) -> str:
    """The table's schema as text, which ``spark.read.schema`` takes."""
    return ", ".join(f"`{name}` {kind}" for name, kind in ALL[table].items())
