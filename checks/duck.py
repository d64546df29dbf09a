"""The derived input tables as DuckDB common table expressions, and SQL helpers.

An independent statement of ``FIXTURES.md``: same rows as ``checks/derive.py``.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
# January lies within Pacific Standard Time, eight hours behind UTC.
PST = "INTERVAL 8 HOUR"


def key(n: str) -> tuple[str, str, str]:
    return (
        f"'proj-' || CAST({n} % 3 AS VARCHAR)",
        f"'ds_' || CAST({n} % 23 AS VARCHAR)",
        f"'tbl_' || CAST({n} % 1500 AS VARCHAR)",
    )


def ref(n: str) -> str:
    p, d, t = key(n)
    return f"struct_pack(project_id := {p}, dataset_id := {d}, table_id := {t})"


def _lbl(k: str, v: str) -> str:
    return f"struct_pack(key := '{k}', value := {v})"


_JOBS = f"""
SELECT event_id, job_id, creation_time, user_email, project_id, job_type, reservation_id, edition,
  CASE WHEN job_type <> 'QUERY' THEN NULL WHEN event_id % 17 = 0 THEN 'SCRIPT' ELSE 'SELECT' END AS statement_type,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE start0 END AS start_time,
  CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN NULL ELSE start0 + to_milliseconds(dur_ms) END AS end_time,
  CASE WHEN event_id % 97 = 0 THEN 'PENDING' WHEN event_id % 89 = 0 THEN 'RUNNING' ELSE 'DONE' END AS state,
  CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 23 = 0 THEN NULL ELSE bytes0 END AS total_bytes_billed,
  bytes0 AS total_bytes_processed,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE dur_ms * (1 + event_id % 700) END AS total_slot_ms,
  CASE WHEN job_type <> 'QUERY' THEN NULL ELSE 'SELECT * FROM t WHERE props = ' || props END AS query,
  {ref('k1')} AS destination_table,
  list_slice([{ref('k1')}, {ref('k2')}], 1,
    CASE WHEN event_id % 41 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE 2 END) AS referenced_tables,
  list_slice([{_lbl('team', "'team-' || CAST(event_id % 5 AS VARCHAR)")},
    {_lbl('env', "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'prod' ELSE 'dev' END")}], 1,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END) AS labels
FROM (
  SELECT event_id, ts AS creation_time, props, ts + to_seconds(event_id % 45) AS start0,
    500 + (event_id * 7919) % 180000 AS dur_ms,
    'job_' || CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS job_id,
    'user' || CAST(user_id AS VARCHAR) || CASE WHEN user_id % 10 = 0
      THEN '-looker@acme-1.iam.gserviceaccount.com' ELSE '@example.com' END AS user_email,
    'proj-' || CAST(event_id % 3 AS VARCHAR) AS project_id,
    CASE event_type WHEN 'purchase' THEN 'LOAD' WHEN 'signup' THEN 'EXTRACT' ELSE 'QUERY' END AS job_type,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'admin:US.res-' || CAST(event_id % 4 AS VARCHAR) END AS reservation_id,
    CASE WHEN event_id % 4 = 1 THEN 'STANDARD' WHEN event_id % 4 = 2 THEN 'ENTERPRISE'
      WHEN event_id % 8 = 3 THEN 'ENTERPRISE PLUS' WHEN event_id % 8 = 7 THEN 'ENTERPRISE_PLUS' END AS edition,
    CAST(round(value * 100) AS BIGINT) * 10485760 AS bytes0, event_id % 150 AS k1, (event_id * 7) % 150 AS k2
  FROM events)
"""

_TIMELINE_COLUMNS = """job_id, project_id, user_email, job_type, statement_type, reservation_id, edition,
  CASE WHEN event_id % 19 = 0 THEN 'job_0' END AS parent_job_id, creation_time AS job_creation_time,
  start_time AS job_start_time, end_time AS job_end_time, total_bytes_billed"""

_JOBS_TIMELINE = f"""
SELECT date_trunc('second', start_time) + to_seconds(n) AS period_start,
  CASE WHEN n = 0 THEN total_slot_ms % ticks ELSE 0 END + (total_slot_ms - total_slot_ms % ticks) // ticks AS period_slot_ms,
  'RUNNING' AS state, NULL AS error_result, {_TIMELINE_COLUMNS}
FROM (SELECT *, unnest(range(ticks)) AS n FROM (
  SELECT *, date_sub('second', date_trunc('second', start_time), end_time) + 1 AS ticks FROM jobs WHERE end_time IS NOT NULL))
UNION ALL
SELECT date_trunc('second', creation_time) + to_seconds(n) AS period_start, NULL AS period_slot_ms,
  'PENDING' AS state, CASE WHEN event_id % 13 = 0 THEN struct_pack(reason := 'rateLimitExceeded', location := 'loc-' || CAST(event_id % 7 AS VARCHAR),
    message := CASE WHEN event_id % 2 = 0 THEN 'quota ' || CAST(event_id % 5 AS VARCHAR) END) END AS error_result, {_TIMELINE_COLUMNS}
FROM (SELECT *, unnest(range(event_id % 45)) AS n FROM jobs)
"""

_RESERVATIONS_TIMELINE = """
SELECT period_start, reservation_name, reservation_id,
  CASE r WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'ENTERPRISE' ELSE 'ENTERPRISE_PLUS' END AS edition,
  100 * r AS slots_assigned, 100 * r AS slot_capacity,
  CAST((SELECT sum(50 * ((seed + u.s) % 5) * (r - 1)) FROM range(60) u(s)) AS BIGINT) AS period_autoscale_slot_seconds,
  50 * (seed % 5) * (r - 1) AS current_slots, 200 * (r - 1) AS max_slots, seed, r
FROM (
  SELECT reservation_id, date_trunc('minute', creation_time) AS period_start, CAST(sum(event_id) AS BIGINT) AS seed,
    split_part(reservation_id, '.', 2) AS reservation_name, CAST(split_part(reservation_id, '-', 2) AS BIGINT) AS r
  FROM jobs WHERE reservation_id IS NOT NULL GROUP BY ALL)
"""

# The per-second details, already one row each.
_RESERVATION_SECONDS = """
SELECT t.reservation_name, t.edition, t.period_start, t.period_start + to_seconds(u.s) AS start_time,
  50 * ((t.seed + u.s) % 5) * (t.r - 1) AS autoscale_current_slots, 200 * (t.r - 1) AS autoscale_max_slots,
  100 * t.r AS slots_assigned, 600 AS slots_max_assigned
FROM reservations_timeline t, range(60) u(s)
"""

_RESERVATIONS = """
SELECT 'res-' || CAST(s_suppkey AS VARCHAR) AS reservation_name,
  CASE s_suppkey % 3 WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'ENTERPRISE' ELSE 'ENTERPRISE_PLUS' END AS edition
FROM supplier
"""

_COMMITMENTS = """
SELECT CASE WHEN s_suppkey % 2 = 1 THEN 'ENTERPRISE' ELSE 'ENTERPRISE_PLUS' END AS edition,
  CASE s_suppkey % 5 WHEN 2 THEN 'MONTHLY' WHEN 4 THEN 'THREE_YEAR' WHEN 1 THEN 'THREE_YEAR' ELSE 'ANNUAL' END AS commitment_plan,
  100 * (1 + s_suppkey % 7) AS slot_count, CASE WHEN s_suppkey % 6 = 5 THEN 'PENDING' ELSE 'ACTIVE' END AS state
FROM supplier
"""

_P, _D, _T = key("p_partkey")

_TABLE_STORAGE = f"""
SELECT project_id, table_schema, table_name, total_rows, total_partitions,
  al + ll AS total_logical_bytes, al AS active_logical_bytes, ll AS long_term_logical_bytes,
  ap + lp AS total_physical_bytes, ap AS active_physical_bytes, lp AS long_term_physical_bytes,
  tt AS time_travel_physical_bytes, fs AS fail_safe_physical_bytes, deleted
FROM (SELECT {_P} AS project_id, {_D} AS table_schema, {_T} AS table_name,
    p_partkey * 10 AS total_rows, p_partkey % 31 AS total_partitions,
    (p_partkey * 7919 % 100000) * 4194304 AS al, (p_partkey * 104729 % 100000) * 2097152 AS ll,
    (p_partkey * 7919 % 50000) * 1048576 + (p_partkey % 40) * 1048576 AS ap, (p_partkey * 104729 % 30000) * 1048576 AS lp,
    (p_partkey % 40) * 1048576 AS tt, (p_partkey % 25) * 1048576 AS fs, p_partkey % 37 = 36 AS deleted FROM part)
"""

_TABLES = f"""
SELECT {_P} AS table_catalog, {_D} AS table_schema,
  {_T} || CASE WHEN p_partkey % 19 = 18 THEN '_new' ELSE '' END AS table_name,
  CASE WHEN p_partkey % 13 = 12 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
FROM part
"""

_SCHEMATA_OPTIONS = """
SELECT 'ds_' || CAST(n AS VARCHAR) AS schema_name,
  CASE WHEN n % 2 = 0 THEN 'storage_billing_model' ELSE 'default_collation' END AS option_name,
  CASE WHEN n % 3 = 0 THEN 'PHYSICAL' ELSE 'LOGICAL' END AS option_value
FROM (SELECT DISTINCT p_partkey % 23 AS n FROM part)
UNION ALL
SELECT DISTINCT 'ds_' || CAST(p_partkey % 23 AS VARCHAR), 'default_table_expiration_days', '30' FROM part
"""

_TABLE_OPTIONS = f"""
SELECT {_P} AS table_catalog, {_D} AS table_schema, {_T} AS table_name,
  CASE WHEN p_partkey % 5 < 2 THEN 'storage_billing_model' ELSE 'description' END AS option_name,
  CASE WHEN p_partkey % 5 = 0 THEN 'PHYSICAL' ELSE 'LOGICAL' END AS option_value
FROM part
"""

_LP, _LD, _LT = key("l_partkey")
_TABLE_STORAGE_USAGE = f"""
SELECT CAST(l_shipdate AS DATE) AS usage_date, {_LP} AS project_id, {_LD} AS table_schema, {_LT} AS table_name,
  q * 1610612736 AS total_logical, q * 1073741824 AS active_logical, q * 536870912 AS long_term_logical,
  q * 402653184 AS total_physical, q * 268435456 AS active_physical, q * 134217728 AS long_term_physical
FROM (SELECT *, CAST(l_quantity AS BIGINT) * 1000 AS q FROM lineitem)
"""

# The audit log as flat rows: nesting adds nothing to the arithmetic.
_TARGET = "destination_table.project_id || '.' || destination_table.dataset_id || '.' || destination_table.table_id"
_AUDIT = f"""
SELECT coalesce(end_time, creation_time) AS ts,
  CASE WHEN event_id % 71 = 0 THEN '' ELSE user_email END AS usr,
  CASE WHEN event_id % 53 = 0 THEN 'table_copy_job_completed' WHEN job_type = 'QUERY' THEN 'query_job_completed'
    WHEN job_type = 'LOAD' THEN 'load_job_completed' ELSE 'extract_job_completed' END AS event_name,
  CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 61 = 0 THEN 'script_job_' || CAST(event_id AS VARCHAR) ELSE job_id END AS job_id,
  CASE WHEN event_id % 2 = 0 THEN 'US' ELSE 'EU' END AS location, project_id,
  event_id % 79 <> 0 AS has_config,
  CASE WHEN event_id % 79 <> 0 AND event_id % 73 = 0 THEN TRUE END AS dry_run,
  CASE WHEN event_id % 79 <> 0 THEN query END AS query,
  CASE WHEN event_id % 79 <> 0 AND job_type = 'LOAD' THEN 'gs://bucket/' || job_id END AS source_uri,
  CASE WHEN event_id % 79 <> 0 AND job_type = 'LOAD' THEN destination_table END AS load_target,
  CASE WHEN event_id % 79 <> 0 AND job_type = 'EXTRACT' THEN {_TARGET} END AS extract_source,
  CASE WHEN event_id % 79 <> 0 AND event_id % 53 = 0 THEN {_TARGET} END AS copy_target,
  CASE WHEN event_id % 79 <> 0 AND event_id % 83 <> 0 THEN labels END AS config_labels, labels AS job_labels,
  start_time, end_time, total_bytes_billed, total_bytes_processed, total_slot_ms, referenced_tables
FROM jobs
"""

# Name -> (text, names it needs), in the order they must be written.
_CTES = {
    "jobs": (_JOBS, ()),
    "jobs_timeline": (_JOBS_TIMELINE, ("jobs",)),
    "reservations_timeline": (_RESERVATIONS_TIMELINE, ("jobs",)),
    "reservation_seconds": (_RESERVATION_SECONDS, ("jobs", "reservations_timeline")),
    "reservations": (_RESERVATIONS, ()),
    "capacity_commitments": (_COMMITMENTS, ()),
    "table_storage": (_TABLE_STORAGE, ()),
    "tables": (_TABLES, ()),
    "schemata_options": (_SCHEMATA_OPTIONS, ()),
    "table_options": (_TABLE_OPTIONS, ()),
    "table_storage_usage": (_TABLE_STORAGE_USAGE, ()),
    "audit": (_AUDIT, ("jobs",)),
}


def with_tables(needs: str, *steps: tuple[str, str], select: str) -> str:
    """One statement: the tables in ``needs``, then named steps, then the select."""
    wanted: list[str] = []
    for name in needs.split():
        for n in (*_CTES[name][1], name):
            if n not in wanted:
                wanted.append(n)
    parts = [f"{n} AS MATERIALIZED ({_CTES[n][0].strip()})" for n in _CTES if n in wanted]
    parts += [f"{n} AS ({text.strip()})" for n, text in steps]
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()


# Expressions.


def r2(x: str) -> str:
    """Two decimals, halves away from zero on the decimal value, as a double."""
    return f"CAST(round(CAST(({x}) AS DECIMAL(38,12)), 2) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST(NULLIF({b}, 0) AS DOUBLE))"


def ms(start: str = "start_time", end: str = "end_time") -> str:
    return f"date_sub('millisecond', {start}, {end})"


def slots(slot_ms: str = "total_slot_ms") -> str:
    return ratio(slot_ms, ms())


def cost(nbytes: str, price: str, per: int = 40) -> str:
    return f"(CAST({nbytes} AS DOUBLE) / {2**per}::DOUBLE * {price}::DOUBLE)"


LADDER = ("totalBytesBilled", "totalMegabytesBilled", "totalGigabytesBilled", "totalTerabytesBilled")


def ladder(nbytes: str, names: tuple[str, ...] = LADDER) -> str:
    b = f"CAST(coalesce({nbytes}, 0) AS DOUBLE)"
    # Halves of whole bytes over a power of two are exact, so the double rounds rightly.
    scaled = [f"round({b} / {2**p}::DOUBLE, 2) AS {n}" for p, n in zip((20, 30, 40), names[1:])]
    return ", ".join([f"{b} AS {names[0]}", *scaled])


def money(x: str) -> str:
    return f"('$ ' || format('{{:,.2f}}', {x}))"


def nano(a: str, b: str) -> str:
    return f"((CAST({a} AS HUGEINT) * 1000000000) // NULLIF({b}, 0))"


def civil(days: int) -> str:
    """Start of a civil look-back; eight hours are taken off and put back."""
    return f"({AS_OF} - {PST} - INTERVAL {days} DAY + {PST})"


def leaf(x: str) -> str:
    """A value as text in quotes; NULL is told from a text of that name."""
    return f"coalesce('''' || {x} || '''', 'NULL')"


def struct_text(*leaves: str, known: str) -> str:
    """``{a,b}`` of texts, or NULL where ``known`` is NULL."""
    return f"CASE WHEN {known} IS NULL THEN 'NULL' ELSE '{{' || {" || ',' || ".join(leaves)} || '}}' END"


def list_text(item: str, column: str) -> str:
    """``[a,b]`` of the items x of a list, or NULL."""
    return f"CASE WHEN {column} IS NULL THEN 'NULL' ELSE '[' || array_to_string([{item} FOR x IN {column}], ',') || ']' END"


def ref_text(x: str) -> str:
    return struct_text(leaf(f"{x}.project_id"), leaf(f"{x}.dataset_id"), leaf(f"{x}.table_id"), known=x)


def refs_text(column: str) -> str:
    return list_text(ref_text("x"), column)


def labels_text(column: str) -> str:
    return list_text(struct_text(leaf("x.key"), leaf("x.value"), known="x"), column)


def of_project(sql: str, project: str) -> str:
    """The statement over the job views of one project; reservations are shared by all."""
    body = f"({_CTES['jobs'][0].strip()})"
    kept = f"jobs_all AS MATERIALIZED {body},\njobs AS (SELECT * FROM jobs_all WHERE project_id = '{project}')"
    return sql.replace(f"jobs AS MATERIALIZED {body}", kept).replace("FROM jobs WHERE reservation_id", "FROM jobs_all WHERE reservation_id")
