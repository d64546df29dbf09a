"""Every report as DuckDB SQL, written from its definition.

Where Spark takes a shorter way, the plain one is taken here on purpose: jobs are
matched with minutes, runs with runs of the same text, and intervals are unfolded.
"""

from __future__ import annotations

from slotwise import fixed_values as fv

from checks.duck import (
    AS_OF,
    PST,
    civil,
    cost,
    labels_text,
    ladder,
    leaf,
    list_text,
    money,
    ms,
    nano,
    of_project,
    r2,
    ratio,
    ref_text,
    refs_text,
    slots,
    struct_text,
    with_tables,
)

PROJECT = "proj-1"
RESERVATION = "res-2"
LOOKER = fv.LOOKER_ACCOUNT
# Reports on reservations alone, which belong to no project.
WITHOUT_PROJECT = ("autoscale_usage_and_costs_per_second", "reservation_cost_per_day")

JOB_RANK = (
    "row_number() OVER (PARTITION BY job_id ORDER BY end_time DESC NULLS LAST, creation_time DESC NULLS LAST, "
    "start_time DESC NULLS LAST, total_slot_ms DESC NULLS LAST, total_bytes_billed DESC NULLS LAST)"
)
TEXT_RANK = (
    "row_number() OVER (PARTITION BY query ORDER BY total_bytes_billed DESC NULLS LAST, {t} DESC NULLS LAST, job_id ASC{more}, total_slot_ms DESC NULLS LAST)"
)
APPROX = f"{r2(slots())} AS approximateSlotCount"
IDS = "job_id AS jobId, project_id AS projectId, start_time AS startTime, end_time AS endTime"


# The order by which each list is cut to its first rows.
LIMIT = 20
_BY_COST = '"onDemandCost" DESC NULLS LAST'
_BY_TABLE = '"user" NULLS FIRST, "projectId" NULLS FIRST, "datasetId" NULLS FIRST, "tableId" NULLS FIRST'
FIRST_ROWS = {
    "longest_running_queries": '"runningTimeInSeconds" DESC NULLS LAST, "jobId" NULLS FIRST',
    "query_counts": '"queryCount" DESC NULLS LAST, query NULLS FIRST',
    "table_query_counts": f'"tableIdCount" DESC NULLS LAST, {_BY_TABLE}',
    "top_billed_labels": f'{_BY_COST}, "labelKey", "labelValue"',
    "top_billed_queries": 'on_demand_cost DESC NULLS LAST, "jobId" NULLS FIRST',
    "top_billed_queries_deduplicated": 'on_demand_cost DESC NULLS LAST, "jobId" NULLS FIRST',
    "top_complex_queries": '"approximateSlotCount" DESC NULLS LAST, "jobId" NULLS FIRST',
    "top_cost_users": f'"user" DESC NULLS LAST, {_BY_COST}',
    "top_costly_queries": f"{_BY_COST}, query NULLS FIRST",
    "audit_longest_running_queries": '"runningTimeInSeconds" DESC NULLS LAST, "jobId" NULLS FIRST, query',
    "audit_query_counts": '"queryCount" DESC NULLS LAST, query NULLS FIRST',
    "audit_table_query_counts": f'"jobCount" DESC NULLS LAST, {_BY_TABLE}',
    "audit_top_billed_labels": f'{_BY_COST}, "labelKey", "labelValue"',
    "audit_top_billed_queries": '"totalBilledBytes" DESC NULLS LAST, "jobId" NULLS FIRST, "timestamp" NULLS FIRST',
    "audit_top_billed_queries_deduplicated": '"totalBilledBytes" DESC NULLS LAST, "jobId" NULLS FIRST',
    "audit_top_complex_queries": '"approximateSlotCount" DESC NULLS LAST, "jobId" NULLS FIRST',
    "audit_top_cost_users": f'"user" DESC NULLS LAST, {_BY_COST}',
    "audit_top_costly_queries": f"{_BY_COST}, query NULLS FIRST",
}


def _finished(days: int, test: str = "TRUE") -> tuple[str, str]:
    return (
        "src",
        f"SELECT * FROM jobs WHERE creation_time BETWEEN {civil(days)} AND {AS_OF} "
        f"AND total_slot_ms IS NOT NULL AND state = 'DONE' AND {test}",
    )


def _latest(days: int, test: str = "TRUE") -> list[tuple[str, str]]:
    return [_finished(days, test), ("d", f"SELECT * FROM src QUALIFY {JOB_RANK} = 1")]


QUERY = "job_type = 'QUERY'"


def _jobs() -> dict[str, str]:
    out = {}
    out["general_job_information"] = with_tables("jobs", *_latest(7), select=f"""
SELECT user_email AS "user", job_type AS jobType, reservation_id AS reservationId,
  CASE WHEN reservation_id IS NULL THEN 'On-Demand' ELSE 'Editions' END AS queryBillingType, query, {IDS},
  {ladder('total_bytes_billed')}, total_slot_ms AS totalSlotMs,
  {r2(cost('total_bytes_billed', '6.25'))} AS onDemandCost, {APPROX} FROM d""")
    out["load_job_information"] = with_tables("jobs", *_latest(7, "job_type = 'LOAD'"), select=f"""
SELECT user_email AS "user", job_type AS jobType, query, {IDS}, total_bytes_processed AS totalBytesProcessed,
  CAST(NULL AS VARCHAR) AS sourceUris, destination_table.project_id AS destinationProjectId,
  destination_table.dataset_id AS datasetId, destination_table.table_id AS tableId, total_slot_ms AS totalSlotMs, {APPROX} FROM d""")
    out["query_job_information"] = with_tables("jobs", *_latest(7, QUERY), select=f"""
SELECT user_email AS "user", query, {IDS}, {refs_text('referenced_tables')} AS referencedTables, {labels_text('labels')} AS labels,
  {r2(cost('total_bytes_billed', '6.25'))} AS onDemandCost, {ladder('total_bytes_billed')}, total_slot_ms AS totalSlotMs, {APPROX} FROM d""")
    out["looker_job_information"] = with_tables("jobs", *_latest(7, f"regexp_matches(user_email, '{LOOKER}')"), select=f"""
SELECT user_email AS "user", job_type AS jobType, query, {IDS}, total_bytes_billed AS totalBytesBilled, total_slot_ms AS totalSlotMs,
  {r2(cost('total_bytes_billed', '5'))} AS "cost", {APPROX} FROM d""")

    longest = f"""
SELECT user_email AS "user", query, {IDS}, date_sub('second', start_time, end_time) AS runningTimeInSeconds,
  {ratio(ms(), 'total_bytes_billed')} AS runtimeToBytesBilledRatio, {ladder('total_bytes_billed')},
  {r2(cost('total_bytes_billed', '5'))} AS "cost", {APPROX} FROM q"""
    names = ("totalBytesBilled", "totalMebibytesBilled", "totalGigibytesBilled", "totalTebibytesBilled")
    billed = f"""
SELECT user_email AS "user", query, {IDS}, {ladder('total_bytes_billed', names)},
  {r2(cost('total_bytes_billed', '6.25'))} AS on_demand_cost, {APPROX} FROM """
    text_rank = TEXT_RANK.format(t="end_time", more=", creation_time DESC NULLS LAST")
    after = ("q", f"SELECT * FROM d QUALIFY {text_rank} = 1")
    both = ("q", f"SELECT * FROM (SELECT *, {JOB_RANK} AS a, {text_rank} AS b FROM src) WHERE a = 1 AND b = 1")
    out["longest_running_queries"] = with_tables("jobs", *_latest(7, QUERY), after, select=longest)
    out["longest_running_queries__literal"] = with_tables("jobs", _finished(7, QUERY), both, select=longest)
    out["top_billed_queries"] = with_tables("jobs", *_latest(14, QUERY), select=billed + "d")
    out["top_billed_queries_deduplicated"] = with_tables("jobs", *_latest(14, QUERY), after, select=billed + "q")
    out["top_billed_queries_deduplicated__literal"] = with_tables("jobs", _finished(14, QUERY), both, select=billed + "q")
    out["top_complex_queries"] = with_tables("jobs", *_latest(14, QUERY), select=f"""
SELECT {APPROX}, user_email AS "user", query, {IDS}, total_bytes_billed AS totalBytesBilled,
  {r2(cost('total_bytes_billed', '6.25'))} AS onDemandCost, date_sub('second', start_time, end_time) AS executionTime,
  {ms()} AS executionTimeMs FROM d""")
    out["top_cost_users"] = with_tables("jobs", *_latest(14, QUERY), select=f"""
SELECT user_email AS "user", {r2(cost('sum(coalesce(total_bytes_billed, 0))', '6.25'))} AS onDemandCost FROM d GROUP BY user_email""")

    label_sums = f"""
SELECT CAST(sum(b) AS BIGINT) AS totalBilledBytes,
  {r2("CAST(sum(b) AS DOUBLE) / 1048576")} AS totalMegabytesBilled, {r2("CAST(sum(b) AS DOUBLE) / 1073741824")} AS totalGigabytesBilled,
  {r2("CAST(sum(b) AS DOUBLE) / 1099511627776")} AS totalTerabytesBilled, {r2(cost('sum(b)', '6.25'))} AS onDemandCost,
  l.key AS labelKey, l.value AS labelValue FROM u GROUP BY l.key, l.value"""
    named = "l.key IS NOT NULL AND l.value IS NOT NULL"
    out["top_billed_labels"] = with_tables("jobs", *_latest(14),
        ("u", f"SELECT * FROM (SELECT coalesce(total_bytes_billed, 0) AS b, unnest(labels) AS l FROM d) WHERE {named}"), select=label_sums)
    rank = JOB_RANK.removesuffix(")") + ", l.key ASC, l.value ASC)"
    out["top_billed_labels__literal"] = with_tables("jobs", _finished(14),
        ("x", f"SELECT * FROM (SELECT *, coalesce(total_bytes_billed, 0) AS b, unnest(labels) AS l FROM src) WHERE {named}"),
        ("u", f"SELECT * FROM x QUALIFY {rank} = 1"), select=label_sums)
    out["table_query_counts"] = with_tables("jobs",
        ("d", f"SELECT * FROM jobs WHERE creation_time BETWEEN {civil(14)} AND {AS_OF} AND total_slot_ms IS NOT NULL QUALIFY {JOB_RANK} = 1"),
        select="""
SELECT user_email AS "user", t.project_id AS projectId, t.dataset_id AS datasetId, t.table_id AS tableId, count(t.table_id) AS tableIdCount
FROM (SELECT user_email, unnest(referenced_tables) AS t FROM d) GROUP BY ALL""")

    counted = f"""SELECT query, n AS queryCount, {r2(cost('b', '5'))} AS onDemandCost, {ladder('b')} FROM c"""
    out["query_counts"] = with_tables("jobs", *_latest(14, QUERY),
        ("c", "SELECT query, count(*) AS n, sum(total_bytes_billed) AS b FROM d WHERE query IS NOT NULL GROUP BY query"), select=counted)
    out["query_counts__literal"] = with_tables("jobs", *_latest(14, QUERY),
        ("p", "SELECT a.query, count(*) AS n FROM d a JOIN d b ON sha256(a.query) = sha256(b.query) GROUP BY a.query"),
        ("s", "SELECT query, sum(total_bytes_billed) AS b FROM d GROUP BY query"),
        ("c", "SELECT p.query, n, b FROM p JOIN s ON p.query = s.query"), select=counted)
    costly = f"""SELECT query, n AS queryCount, {ladder('b')}, {r2(cost('b', '6.25'))} AS onDemandCost FROM c"""
    out["top_costly_queries"] = with_tables("jobs", *_latest(14, QUERY),
        ("c", "SELECT query, count(*) AS n, sum(coalesce(total_bytes_billed, 0)) AS b FROM d WHERE query IS NOT NULL GROUP BY query"), select=costly)
    out["top_costly_queries__literal"] = with_tables("jobs", *_latest(14, QUERY),
        ("c", "SELECT a.query, count(*) AS n, sum(coalesce(a.total_bytes_billed, 0)) AS b FROM d a JOIN d b "
              "ON sha256(a.query) = sha256(b.query) AND a.job_id <> b.job_id GROUP BY a.query"), select=costly)
    return out


def _slots_sql(unit: str, test: str, by_user: bool = False) -> str:
    usage = "slotUsage" if unit == "second" else "slot_usage"
    length = {"second": 1000, "minute": 60000, "hour": 3600000, "day": 86400000}[unit]
    user = ", user_email" if by_user else ""
    local = lambda t: f"date_trunc('{unit}', {t} - {PST})"
    return with_tables("jobs_timeline",
        ("facts", f"""SELECT {local('period_start')} AS tick{user}, CAST(sum(period_slot_ms) AS DOUBLE) / {length} AS used
FROM jobs_timeline WHERE period_start BETWEEN {civil(7)} AND {AS_OF} AND {test} GROUP BY ALL"""),
        ("grid", f"SELECT unnest(generate_series({local(f'({AS_OF} - INTERVAL 7 DAY)')}, {local(AS_OF)}, INTERVAL 1 {unit})) AS tick"),
        select=f"""SELECT coalesce(used, 0) AS {usage}{user}, grid.tick AS "timeInterval_PST" FROM grid LEFT JOIN facts ON grid.tick = facts.tick""")


def _timeline() -> dict[str, str]:
    out = {}
    no_script = "statement_type <> 'SCRIPT'"
    for unit in ("day", "hour", "minute", "second"):
        out[f"slots_by_{unit}"] = _slots_sql(unit, no_script)
    out["slots_by_minute_and_user"] = _slots_sql("minute", no_script, True)
    untyped = "(statement_type <> 'SCRIPT' OR statement_type IS NULL)"
    for unit in ("day", "hour", "minute"):
        out[f"slots_by_{unit}__include_null_type"] = _slots_sql(unit, untyped)
    out["slots_by_minute_and_user__include_null_type"] = _slots_sql("minute", untyped, True)
    for unit in ("minute", "second"):
        out[f"load_slots_per_{unit}"] = _slots_sql(unit, "job_type = 'LOAD'")
        out[f"query_slots_per_{unit}"] = _slots_sql(unit, QUERY)
    out["query_slots_per_minute_and_user"] = _slots_sql("minute", QUERY, True)

    for unit in ("millisecond", "second", "minute"):
        src = f"""SELECT date_trunc('{unit}', period_start) AS tick, period_start AS p, job_id, job_creation_time FROM jobs_timeline
WHERE job_creation_time BETWEEN {civil(7)} AND {AS_OF} AND job_type = 'QUERY' AND parent_job_id IS NULL"""
        out[f"concurrent_queries_by_{unit}"] = with_tables("jobs_timeline", ("src", src),
            select="SELECT tick AS period_start, count(DISTINCT job_id) AS job_count FROM src GROUP BY tick")
        out[f"concurrent_queries_by_{unit}__literal"] = with_tables("jobs_timeline", ("src", src),
            ("d", "SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY job_creation_time DESC NULLS LAST, p ASC) = 1"),
            select="SELECT tick AS period_start, count(job_id) AS job_count FROM d GROUP BY tick")
    out["queued_queries_by_second"] = with_tables("jobs_timeline", select=f"""
SELECT period_start, count(DISTINCT job_id) AS queued_jobs_cnt FROM jobs_timeline
WHERE job_creation_time BETWEEN {civil(1)} AND {AS_OF} AND state = 'PENDING' GROUP BY period_start""")
    out["queued_jobs"] = with_tables("jobs_timeline", select=f"""
SELECT DISTINCT job_id, period_start, project_id, user_email, job_type, error_result.reason AS error_reason, error_result.location AS error_location,
  error_result.message AS error_message FROM jobs_timeline WHERE job_creation_time BETWEEN {civil(1)} AND {AS_OF} AND state = 'PENDING'""")
    for form, typed in (("", no_script), ("__include_null_type", untyped)):
        out["concurrent_queued_and_running_jobs_per_minute" + form] = with_tables("jobs",
        ("t", f"SELECT unnest(generate_series({AS_OF} - INTERVAL 24 HOUR, {AS_OF}, INTERVAL 1 MINUTE)) AS m"),
        ("j", f"SELECT * FROM jobs WHERE creation_time >= {AS_OF} - INTERVAL 25 HOUR AND job_type = 'QUERY' AND {typed}"),
        select="""
SELECT m AS "minute", count(*) FILTER (WHERE start_time <= m AND (end_time > m OR end_time IS NULL)) AS concurrent_running,
  count(*) FILTER (WHERE creation_time <= m AND (start_time > m OR start_time IS NULL)) AS concurrent_queued
FROM t LEFT JOIN j ON creation_time <= m AND (end_time > m OR end_time IS NULL) GROUP BY m""")
    # Buckets here have few jobs; sketches count those exactly.
    for name in ("concurrent_queries_by_millisecond", "concurrent_queries_by_second", "concurrent_queries_by_minute", "queued_queries_by_second"):
        out[f"{name}__approximate"] = out[name]
    return out


def _billing() -> dict[str, str]:
    out = {}
    hours = f"(CAST(CASE WHEN {ms()} < 60000 THEN 60000 ELSE {ms()} END AS DOUBLE) / 3600000)"
    runs = ("r", f"""SELECT project_id, query, start_time, end_time, {r2(slots())} AS s, {hours} AS h,
  coalesce(total_bytes_billed, 0) AS b FROM src WHERE query IS NOT NULL""")
    plans = [("standardEdition", 0.04), ("enterpriseEdition", 0.06), ("enterpriseEdition1Year", 0.048), ("enterpriseEdition3Year", 0.036),
             ("enterprisePlusEdition", 0.1), ("enterprisePlusEdition1Year", 0.08), ("enterprisePlusEdition3Year", 0.06)]
    for literal in (False, True):
        used = "h" if literal else "(h * up)"
        costs = ", ".join(f"{used} * {rate}::DOUBLE AS {name}Cost" for name, rate in plans)
        plus, plus1 = ("enterpriseEdition", "enterpriseEdition1Year") if literal else ("enterprisePlusEdition", "enterprisePlusEdition1Year")
        text1 = "Enterprise Edition 1 Year Commit" if literal else "Enterprise Plus Edition 1 Year Commit"
        advice = [("standardEdition", "standardEditionRecommendation", "Standard Edition"),
                  ("enterpriseEdition", "enterpriseEditionRecommendation", "Enterprise Edition"),
                  ("enterpriseEdition1Year", "enterpriseEdition1YearRecommendation", "Enterprise Edition 1 Year Commit"),
                  ("enterpriseEdition3Year", "enterpriseEdition3YearRecommendation", "Enterprise Edition 3 Year Commit"),
                  (plus, "enterprisePlusEditionRecommendation", "Enterprise Plus Edition"),
                  (plus1, "enterpriseEditionPlus1YearRecommendation", text1),
                  ("enterprisePlusEdition3Year", "enterprisePlusEdition3YearRecommendation", "Enterprise Plus Edition 3 Year Commit")]
        shown = ", ".join(f"CASE WHEN onDemandCost - {c}Cost < 0 THEN 'On-demand' ELSE '{t}' END AS {n}" for c, n, t in advice)
        out["billing_recommendation_per_query" + ("__literal" if literal else "")] = with_tables("jobs", _finished(14), runs,
            ("up", "SELECT *, CAST(ceil(s / 50) * 50 AS DOUBLE) AS up FROM r"),
            ("c", f"SELECT *, {cost('b', '5')} AS legacyOnDemandCost, {cost('b', '6.25')} AS onDemandCost, {costs} FROM up"),
            select=f"""
SELECT project_id AS projectid, query, {shown}, start_time AS startTime, end_time AS endTime, h AS editionsBilledDurationInHours,
  s AS approximateSlotCount, up AS billedSlotCount, legacyOnDemandCost, onDemandCost,
  {', '.join(f'{n}Cost' for n, _ in plans)}, {ladder('b')} FROM c""")
        if literal:
            billed = (f"greatest({r2('CAST(b AS DOUBLE)')}, 10485760) AS billedBytes, greatest({r2('CAST(b AS DOUBLE) / 1048576')}, 10) AS billedMegabytes, "
                      f"greatest({r2('CAST(b AS DOUBLE) / 1073741824')}, 10::DOUBLE / 1024) AS billedGigabytes, "
                      f"greatest({r2('CAST(b AS DOUBLE) / 1099511627776')}, 10::DOUBLE / 1048576) AS billedTerabytes")
        else:
            billed = ladder("greatest(b, 10485760)", ("billedBytes", "billedMegabytes", "billedGigabytes", "billedTerabytes"))
        out["costs_by_query" + ("__literal" if literal else "")] = with_tables("jobs", _finished(7), runs,
            ("n", "SELECT query, count(query) AS n FROM r GROUP BY query"),
            ("c", "SELECT r.*, n.n, CAST(floor((ceil(s) + 49) / 50) * 50 AS DOUBLE) AS up FROM r JOIN n ON r.query = n.query"),
            select=f"""
SELECT project_id AS projectId, query, start_time AS startTime, end_time AS endTime, h AS queryDurationHours, s AS approximateSlotCount,
  up AS billedSlotCount, up * h AS slotHours, {cost('greatest(b, 10485760)', '6.25')} AS onDemandCost, n AS executionCount, {billed} FROM c""")
        minute = "period_start" if literal else "date_trunc('minute', period_start)"
        plan = lambda base, payg: r2(f"CAST(baseline * 43200 AS DOUBLE) / 60 * {base}::DOUBLE + CAST(over AS DOUBLE) / 60 * {payg}::DOUBLE")
        floor10 = "sum(CASE WHEN total_bytes_billed IS NULL THEN NULL ELSE greatest(total_bytes_billed, 10485760) END)"
        out["total_billing_recommendation" + ("__literal" if literal else "")] = with_tables("jobs_timeline",
            ("m", f"""SELECT {minute} AS tick, ceil(CAST(sum(period_slot_ms) AS DOUBLE) / 60000 / 50) * 50 AS p FROM jobs_timeline
WHERE period_start BETWEEN {civil(30)} AND {AS_OF} AND job_type = 'QUERY' GROUP BY ALL"""),
            ("o", f"""SELECT count(*) AS runs, count(DISTINCT query) AS texts, CAST({floor10} AS DOUBLE) / 1099511627776 AS tib
FROM jobs WHERE creation_time BETWEEN {civil(30)} AND {AS_OF}"""),
            ("s", """SELECT b.baseline, (SELECT sum(greatest(p, b.baseline) - b.baseline) FROM m WHERE p IS NOT NULL) AS over
FROM (SELECT unnest([0, 50, 100, 200, 500, 1000]) AS baseline) b"""),
            ("c", f"""SELECT 'Last 30 days' AS time_period, texts AS total_unique_queries, runs AS total_query_executions,
  {r2('tib')} AS total_terabytes_billed, {r2('tib * 6.25::DOUBLE')} AS total_on_demand_cost, CAST(baseline AS BIGINT) AS baseline_slots,
  {plan(0.04, 0.04)} AS standard_total_cost, {plan(0.06, 0.06)} AS enterprise_payg_cost, {plan(0.048, 0.06)} AS enterprise_1yr_cost,
  {plan(0.036, 0.06)} AS enterprise_3yr_cost, {plan(0.1, 0.1)} AS enterprise_plus_payg_cost, {plan(0.08, 0.1)} AS enterprise_plus_1yr_cost,
  {plan(0.06, 0.1)} AS enterprise_plus_3yr_cost FROM s, o"""),
            select=f"""
SELECT *, {r2('total_on_demand_cost - enterprise_3yr_cost')} AS savings_vs_ondemand_at_3yr,
  {r2('100::DOUBLE * (total_on_demand_cost - enterprise_3yr_cost) / NULLIF(total_on_demand_cost, 0)')} AS savings_pct_at_3yr FROM c""")
    return out


def _reservations() -> dict[str, str]:
    out = {}
    for literal in (False, True):
        suffix = "__literal" if literal else ""
        edition = "edition" if literal else "replace(edition, '_', ' ')"
        rate = (f"(CASE {edition} WHEN 'STANDARD' THEN 0.000011111::DECIMAL(18,9) WHEN 'ENTERPRISE' THEN 0.000016667::DECIMAL(18,9) "
                "WHEN 'ENTERPRISE PLUS' THEN 0.000027778::DECIMAL(18,9) END)")
        assigned = ("slots_assigned AS slots_assigned_cost" if literal
                    else f"slots_assigned, CAST({rate} * slots_assigned AS DOUBLE) AS slots_assigned_cost")
        total = f"CAST({rate} * autoscale_current_slots + {rate} * slots_assigned AS DOUBLE)"
        recent = f"period_start BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}"
        out["autoscale_usage_and_costs_per_second" + suffix] = with_tables("reservation_seconds", select=f"""
SELECT start_time, reservation_name, autoscale_current_slots, autoscale_max_slots,
  {ratio('autoscale_current_slots', 'autoscale_max_slots')} AS autoscale_usage_ratio,
  CAST({rate} * autoscale_current_slots AS DOUBLE) AS autoscaled_cost, {assigned}, slots_max_assigned,
  {total} AS total_slots_cost, {money(total)} AS total_slots_cost_formatted
FROM reservation_seconds WHERE {recent}""")
        number = lambda c: leaf(f"CAST(CAST({c} AS DECIMAL(28,6)) AS VARCHAR)")
        job = struct_text(
            leaf("CAST(period_slot_ms AS VARCHAR)"), number("period_slot_s"), number("editions_cost"), *map(leaf, ("project_id", "user_email", "job_id", "statement_type")),
            leaf("CAST(epoch_us(job_start_time) AS VARCHAR)"), leaf("state"), leaf("CAST(total_bytes_billed_for_full_job AS VARCHAR)"), known="job_id",
        )
        jobs = f"'[' || string_agg({job}, ',' ORDER BY {job}) || ']' AS jobs" if literal else "j.* EXCLUDE (start_time, reservation_name)"
        grouped = " GROUP BY ALL" if literal else ""
        out["queries_and_reservation_usage_per_second" + suffix] = with_tables("reservation_seconds jobs_timeline",
            ("j", f"""SELECT period_start AS start_time, split_part(reservation_id, '.', -1) AS reservation_name, period_slot_ms,
  CAST(period_slot_ms AS DOUBLE) / 1000 AS period_slot_s, CAST({rate} AS DOUBLE) * (CAST(period_slot_ms AS DOUBLE) / 1000) AS editions_cost,
  project_id, user_email, job_id, statement_type, job_start_time, state, total_bytes_billed AS total_bytes_billed_for_full_job
FROM jobs_timeline WHERE period_start BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF} AND job_creation_time BETWEEN {civil(7)} AND {AS_OF}
  AND job_type = 'QUERY' AND (statement_type <> 'SCRIPT' OR statement_type IS NULL)"""),
            select=f"""
SELECT s.start_time, s.reservation_name, s.edition, s.autoscale_current_slots, s.autoscale_max_slots, s.slots_assigned, s.slots_max_assigned,
  {jobs}
FROM reservation_seconds s JOIN j ON s.start_time = j.start_time AND s.reservation_name = j.reservation_name WHERE s.{recent}{grouped}""")
        used = "j.slots" if literal else "coalesce(j.slots, 0)"
        out["bqe_slot_utilization_by_minute" + suffix] = with_tables("reservations_timeline jobs_timeline",
            ("r", f"SELECT * FROM reservations_timeline WHERE period_start > {AS_OF} - INTERVAL 7 DAY AND reservation_name = '{RESERVATION}'"),
            ("j", f"""SELECT date_trunc('minute', period_start) AS tick, a.reservation_id, count(DISTINCT job_id) AS jobs,
  {r2('CAST(sum(period_slot_ms) AS DOUBLE) / 60000')} AS slots
FROM jobs_timeline a JOIN (SELECT DISTINCT reservation_id FROM r) b ON a.reservation_id = b.reservation_id
WHERE period_slot_ms IS NOT NULL AND job_creation_time > {AS_OF} - INTERVAL 7 DAY AND (statement_type <> 'SCRIPT' OR statement_type IS NULL)
GROUP BY ALL"""),
            select=f"""
SELECT r.period_start, r.reservation_name, r.slots_assigned, r.current_slots, r.max_slots, r.reservation_id,
  coalesce(j.jobs, 0) AS active_jobs_per_period, coalesce(j.slots, 0) AS slots_per_period,
  CASE WHEN r.current_slots = 0 THEN 0 ELSE {used} / CAST(r.current_slots AS DOUBLE) * 100 END AS utilization_pct
FROM r LEFT JOIN j ON r.period_start = j.tick AND r.reservation_id = j.reservation_id""")
        other = "0" if literal else "CASE edition WHEN 'ENTERPRISE' THEN 0.06::DOUBLE WHEN 'ENTERPRISE_PLUS' THEN 0.1::DOUBLE ELSE 0.04::DOUBLE END"
        out["reservation_cost_per_day" + suffix] = with_tables("reservations_timeline reservations capacity_commitments",
            ("k", """SELECT edition, commitment_plan, CAST(sum(slot_count) AS DOUBLE) AS n FROM capacity_commitments WHERE state = 'ACTIVE' GROUP BY ALL"""),
            ("kr", f"""SELECT *, CASE WHEN edition = 'ENTERPRISE' AND commitment_plan = 'ANNUAL' THEN 0.048::DOUBLE
  WHEN edition = 'ENTERPRISE' AND commitment_plan = 'THREE_YEAR' THEN 0.036::DOUBLE
  WHEN edition = 'ENTERPRISE_PLUS' AND commitment_plan = 'ANNUAL' THEN 0.08::DOUBLE
  WHEN edition = 'ENTERPRISE_PLUS' AND commitment_plan = 'THREE_YEAR' THEN 0.06::DOUBLE ELSE {other} END AS rate FROM k"""),
            ("ct", "SELECT edition, sum(n) AS n, sum(n * rate ORDER BY commitment_plan) AS hourly FROM kr GROUP BY edition"),
            ("p", """SELECT e.edition, x.payg, coalesce(hourly / NULLIF(n, 0), x.payg) AS base
FROM (SELECT unnest(['STANDARD', 'ENTERPRISE', 'ENTERPRISE_PLUS']) AS edition) e
JOIN (VALUES ('STANDARD', 0.04::DOUBLE), ('ENTERPRISE', 0.06::DOUBLE), ('ENTERPRISE_PLUS', 0.1::DOUBLE)) x(edition, payg) ON e.edition = x.edition
LEFT JOIN ct ON e.edition = ct.edition"""),
            ("u", f"""SELECT CAST(period_start AS DATE) AS usage_date, reservation_name, CAST(sum(slot_capacity) AS DOUBLE) / 60 AS held,
  CAST(sum(period_autoscale_slot_seconds) AS DOUBLE) / 3600 AS scaled
FROM reservations_timeline WHERE period_start >= {AS_OF} - INTERVAL 7 DAY GROUP BY ALL"""),
            select=f"""
SELECT CAST(u.usage_date AS TIMESTAMP) AS usage_date, u.reservation_name, r.edition, {r2('held')} AS total_baseline_slot_hours, {r2('scaled')} AS total_autoscale_slot_hours,
  {r2('held * base')} AS daily_baseline_cost, {r2('scaled * payg')} AS daily_autoscale_cost,
  {r2('held * base + scaled * payg')} AS total_daily_reservation_cost
FROM u JOIN reservations r ON u.reservation_name = r.reservation_name LEFT JOIN p ON r.edition = p.edition""")
    return out


def _size_text(x: str) -> str:
    step = lambda p, n: f"format('{{:.2f}}', CAST({x} AS DOUBLE) / {2**p}::DOUBLE) || ' {n}'"
    return (f"CASE WHEN {x} >= {2**40} THEN {step(40, 'TiB')} WHEN {x} >= {2**30} THEN {step(30, 'GiB')} "
            f"WHEN {x} >= {2**20} THEN {step(20, 'MiB')} ELSE {step(10, 'KB')} END")


def _storage() -> dict[str, str]:
    out = {}
    sums = """SELECT {keys}, sum(active_logical_bytes) AS al, sum(long_term_logical_bytes) AS ll,
  sum(active_physical_bytes - time_travel_physical_bytes) AS ap, sum(long_term_physical_bytes) AS lp,
  sum(time_travel_physical_bytes) AS tt, sum(fail_safe_physical_bytes) AS fs FROM s GROUP BY ALL"""
    gib = lambda c: f"CAST({c} AS DOUBLE) / 1073741824"
    priced = f"""SELECT *, {gib('al')} * 0.02::DOUBLE AS pal, {gib('ll')} * 0.01::DOUBLE AS pll, {gib('ap')} * 0.04::DOUBLE AS pap,
  {gib('lp')} * 0.02::DOUBLE AS plp, {gib('tt')} * 0.04::DOUBLE + {gib('fs')} * 0.04::DOUBLE AS extra FROM a"""
    totals = "SELECT *, pal + pll AS lo, (pap + plp) + extra AS ph FROM p"
    for literal in (False, True):
        suffix = "__literal" if literal else ""
        also = "" if literal else "AND t.table_schema = tb.table_schema"
        join = f"""FROM table_storage tb JOIN tables t ON t.table_catalog = tb.project_id AND t.table_name = tb.table_name {also}
WHERE tb.deleted = FALSE AND t.table_type = 'BASE TABLE'"""
        sizes = "tb.total_rows, tb.total_partitions, tb.total_logical_bytes, tb.active_logical_bytes, tb.long_term_logical_bytes, tb.total_physical_bytes, tb.active_physical_bytes, tb.long_term_physical_bytes, tb.time_travel_physical_bytes, tb.fail_safe_physical_bytes"
        out["project_per_table_storage_model_recommendations" + suffix] = with_tables("table_storage tables",
            ("s", f"SELECT DISTINCT tb.table_name, tb.table_schema AS dataset, {sizes} {join}"),
            ("a", sums.format(keys="dataset, table_name")), ("p", priced), ("f", totals), select=f"""
SELECT dataset, table_name, {money('pal')} AS logical_active_price, {money('pap')} AS base_physical_price, {money('pll')} AS logical_long_term_price,
  {money('plp')} AS base_long_term_price, {money('extra')} AS additional_costs_for_physical_storage, {money('lo')} AS logical_storage_price,
  {money('ph')} AS physical_storage_price, {money('lo - ph')} AS difference_in_price_if_physical_is_chosen,
  CASE WHEN lo < ph THEN 'Logical storage' ELSE 'Physical storage' END AS recommendation FROM f""")
        texts = {m: (fv.SET_LOCATION.replace("<location>", "us") + text).replace("'", "''") for m, text in (("PHYSICAL", fv.SET_PHYSICAL), ("LOGICAL", fv.SET_LOGICAL))}
        ddl = lambda m: f"replace('{texts[m]}', '<dataset>', dataset)"
        out["project_storage_model_recommendation" + suffix] = with_tables("table_storage tables schemata_options",
            ("s0", f"SELECT DISTINCT tb.table_schema, tb.table_name, tb.project_id || '.' || tb.table_schema AS dataset, {sizes} {join}"),
            ("s", """SELECT s0.*, coalesce(o.option_value, 'LOGICAL') AS model FROM s0
LEFT JOIN (SELECT * FROM schemata_options WHERE option_name = 'storage_billing_model') o ON s0.table_schema = o.schema_name"""),
            ("a", sums.format(keys="dataset, model")), ("p", priced), ("f", totals), select=f"""
SELECT dataset, {money('pal')} AS logical_active_price, {money('pll')} AS logical_long_term_price, {money('pap')} AS physical_active_price,
  {money('plp')} AS physical_long_term_price, {money('extra')} AS additional_costs_for_physical_storage, {money('lo')} AS logical_storage_price,
  {money('ph')} AS physical_storage_price, {money('lo - ph')} AS savings_in_price_if_physical_is_chosen, model AS current_storage_model,
  CASE WHEN model = 'LOGICAL' AND lo < ph THEN '{fv.KEEP_LOGICAL}'
    WHEN model = 'LOGICAL' THEN '{fv.GO_PHYSICAL}'
    WHEN lo < ph THEN '{fv.GO_LOGICAL}'
    ELSE '{fv.KEEP_PHYSICAL}' END AS recommendation,
  CASE WHEN model = 'LOGICAL' AND NOT lo < ph THEN {ddl('PHYSICAL')} WHEN model <> 'LOGICAL' AND lo < ph THEN {ddl('LOGICAL')} END AS "recommendation_change_SQL"
FROM f""")
    stamp = "strftime(last, '%Y-%m-%d %H:%M:%S') || CASE WHEN date_part('microsecond', last) % 1000000 = 0 THEN '' WHEN date_part('microsecond', last) % 1000 = 0 THEN strftime(last, '.%g') ELSE strftime(last, '.%f') END || '+00'"
    out["table_storage_by_most_recently_queried"] = with_tables("jobs table_storage tables table_options",
        ("u", f"""SELECT r.project_id, r.dataset_id, r.table_id, max(creation_time) AS last FROM (
  SELECT creation_time, unnest(referenced_tables) AS r FROM jobs WHERE job_type = 'QUERY' AND state = 'DONE'
  AND creation_time BETWEEN {civil(14)} AND {AS_OF}) GROUP BY ALL"""),
        ("m", """SELECT ts.project_id, ts.table_schema AS dataset_id, ts.table_name AS table_id, coalesce(o.option_value, 'LOGICAL') AS model,
  CASE WHEN o.option_value = 'PHYSICAL' THEN ts.total_physical_bytes ELSE ts.total_logical_bytes END AS tb,
  CASE WHEN o.option_value = 'PHYSICAL' THEN ts.active_physical_bytes ELSE ts.active_logical_bytes END AS ab,
  CASE WHEN o.option_value = 'PHYSICAL' THEN ts.long_term_physical_bytes ELSE ts.long_term_logical_bytes END AS lb
FROM table_storage ts JOIN tables t ON ts.project_id = t.table_catalog AND ts.table_schema = t.table_schema AND ts.table_name = t.table_name
LEFT JOIN table_options o ON ts.project_id = o.table_catalog AND ts.table_schema = o.table_schema AND ts.table_name = o.table_name
  AND o.option_name = 'storage_billing_model'"""),
        select=f"""
SELECT m.project_id, m.dataset_id, m.table_id, CASE WHEN last IS NULL THEN 'Prior to 2024-01-17 00:00:00+00' ELSE {stamp} END AS last_queried_time,
  model AS storage_billing_model, {money(f"{gib('ab')} * CASE WHEN model = 'LOGICAL' THEN 0.02::DOUBLE ELSE 0.04::DOUBLE END + {gib('lb')} * CASE WHEN model = 'LOGICAL' THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END")} AS table_storage_price,
  {_size_text('tb')} AS readable_total_billed_size, tb AS total_billed_bytes, {_size_text('ab')} AS readable_active_size, ab AS active_billed_bytes,
  {_size_text('lb')} AS readable_long_term_size
FROM m LEFT JOIN u ON m.project_id = u.project_id AND m.dataset_id = u.dataset_id AND m.table_id = u.table_id""")
    hourly = {"active_logical": "0.000027397", "long_term_logical": "0.000013699", "active_physical": "0.000054795", "long_term_physical": "0.000027397"}
    columns = []
    for model in ("logical", "physical"):
        for span in ("total", "active", "long_term"):
            k = f"{span}_{model}"
            g = f"CAST(sum({k}) AS DOUBLE) / 1073741824"
            columns += [f"{g} AS billable_{k}_usage_in_gibytes", f"CAST(sum({k}) AS DOUBLE) / 1099511627776 AS billable_{k}_usage_in_tibytes"]
            if k in hourly:
                c = f"{g} * {hourly[k]}::DOUBLE"
                columns += [f"{c} AS {k}_cost", f"{money(c)} AS {k}_pretty_cost"]
    out["table_usage_and_costs_per_day"] = with_tables("table_storage_usage", select=f"""
SELECT CAST(usage_date AS TIMESTAMP) AS usage_date, project_id, table_schema, table_name, {', '.join(columns)} FROM table_storage_usage
WHERE usage_date >= DATE '2001-10-08' GROUP BY usage_date, project_id, table_schema, table_name""")
    return out


# Audit log.

EVENT_TYPE = "CASE event_name " + " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in fv.EVENT_TYPES.items()) + " END"
EVENT_RANK = ("row_number() OVER (PARTITION BY job_id ORDER BY ts DESC NULLS LAST, end_time DESC NULLS LAST, start_time DESC NULLS LAST, "
              "total_slot_ms DESC NULLS LAST, total_bytes_billed DESC NULLS LAST, event_name DESC NULLS LAST)")
A_IDS = 'job_id AS jobId, location, project_id AS billingProjectId, start_time AS startTime, end_time AS endTime'


def _events(days: int, project: str | None, *, kind: str | None = None, tests: str = "has_config AND dry_run IS NULL AND project_id IS NOT NULL",
            also: str = "TRUE", since: str | None = None) -> tuple[str, str]:
    name = f"event_name = '{kind}_job_completed'" if kind else "event_name LIKE '%_job_completed'"
    scope = f"project_id = '{project}'" if project else "TRUE"
    window = since or f"ts >= TIMESTAMP '2024-01-31' - INTERVAL {days} DAY"
    return ("src", f"SELECT * FROM audit WHERE job_id IS NOT NULL AND job_id NOT LIKE 'script_job_%' AND {name} "
            f"AND usr IS NOT NULL AND usr <> '' AND {tests} AND {scope} AND {also} AND {window}")


LATEST = ("d", f"SELECT * FROM src QUALIFY {EVENT_RANK} = 1")
BYTES0 = "coalesce(total_bytes_billed, 0)"
NO_CONFIG = "dry_run IS NULL AND project_id IS NOT NULL"
STARTED = "start_time >= TIMESTAMP '2024-01-30'"


def _rate(literal: bool) -> str:
    return ratio(ms(), "total_slot_ms") if literal else slots()


def _alive(unit: str, table: str, aligned: bool = True) -> str:
    first = f"date_trunc('{unit}', start_time)" if aligned else "start_time"
    return f"SELECT *, unnest(generate_series({first}, end_time, INTERVAL 1 {unit})) AS tick FROM {table} WHERE start_time IS NOT NULL AND end_time IS NOT NULL"


def _audit_scoped(project: str | None) -> dict[str, str]:
    """Reports that exist for one project and for all; named without the suffix."""
    out = {}
    for literal in (False, True):
        suffix = "__literal" if literal else ""
        lists = f"""
SELECT usr AS "user", {EVENT_TYPE} AS eventType, {struct_text(leaf('query'), known='query')} AS query,
  {struct_text(list_text(leaf('x'), '[source_uri]'), ref_text('load_target'), known='load_target')} AS load,
  {struct_text(leaf('extract_source'), known='extract_source')} AS extract, {struct_text(leaf('copy_target'), known='copy_target')} AS tableCopy,
  ts AS "timestamp", {A_IDS}, """
        tail = f"total_slot_ms AS totalSlotMs, {ms()} AS executionTimeMs, {_rate(literal)} AS approximateSlotCount FROM d"
        out["general_job_information" + suffix] = with_tables("audit", _events(7, project), LATEST, select=lists +
            f"{r2(cost(BYTES0, '5'))} AS \"cost\", {BYTES0} AS totalBilledBytes, " + tail)
        out["looker_job_information" + suffix] = with_tables("audit", _events(5, project, also=f"regexp_matches(usr, '{LOOKER}')"), LATEST,
            select=lists + "total_bytes_billed AS totalBilledBytes, " + tail)
        out["load_job_information" + suffix] = with_tables("audit",
            _events(5, project, kind="load", tests="project_id IS NOT NULL AND load_target IS NOT NULL"), LATEST, select=f"""
SELECT usr AS user_email, ts AS "timestamp", {A_IDS}, total_bytes_processed AS totalProcessedBytes, {list_text(leaf('x'), '[source_uri]')} AS sourceUris,
  load_target.project_id AS destinationProjectId, load_target.dataset_id AS destinationDatasetId, load_target.table_id AS destinationTabletId,
  total_slot_ms AS totalSlotMs, {ms()} AS executionTimeMs, {_rate(literal)} AS approximateSlotCount FROM d""")
        labels = "job_labels" if literal else "coalesce(config_labels, job_labels)"
        out["query_job_information" + suffix] = with_tables("audit", _events(7, project, kind="query"), LATEST, select=f"""
SELECT usr AS "user", job_id AS jobId, project_id AS projectId, start_time AS startTime, end_time AS endTime,
  {refs_text('referenced_tables')} AS referencedTables, {labels_text(labels)} AS labels, {r2(cost(BYTES0, '5'))} AS onDemandCost,
  {ladder('total_bytes_billed')}, total_slot_ms AS totalSlotMs, {slots()} AS approximateSlotCount FROM d""")
        out["longest_running_queries" + suffix] = with_tables("audit", _events(700, project), LATEST,
            ("q", f"SELECT * FROM {'src' if literal else 'd'} QUALIFY {TEXT_RANK.format(t='ts', more='')} = 1"), select=f"""
SELECT usr AS "user", job_id AS jobId, query, project_id AS projectId, date_sub('second', start_time, end_time) AS runningTimeInSeconds,
  {ratio(ms(), 'total_bytes_billed')} AS runtimeToBytesBilledRatio, start_time AS startTime, end_time AS endTime,
  {r2(cost(BYTES0, '5'))} AS onDemandCost, {ladder('total_bytes_billed')}, {slots()} AS approximateSlotCount FROM q""")
        per = 30 if literal and project else 40
        if literal:
            steps = [("p", "SELECT a.query, count(*) AS n FROM src a JOIN src b ON sha256(a.query) = sha256(b.query) GROUP BY a.query"),
                     ("s", f"SELECT query, sum({BYTES0}) AS b FROM d GROUP BY query"),
                     ("c", "SELECT p.query, n, b FROM p JOIN s ON p.query = s.query")]
        else:
            steps = [("c", f"SELECT query, count(*) AS n, sum({BYTES0}) AS b FROM d WHERE query IS NOT NULL GROUP BY query")]
        out["query_counts" + suffix] = with_tables("audit", _events(700, project), LATEST, *steps, select=
            f"SELECT query, n AS queryCount, {r2(cost('b', '5', per))} AS onDemandCost, {ladder('b')} FROM c")
        pairs = (f"SELECT a.query, count(*) AS n, sum(coalesce(a.total_bytes_billed, 0)) AS b FROM d a JOIN d b ON sha256(a.query) = sha256(b.query) "
                 "AND a.job_id <> b.job_id GROUP BY a.query") if literal else steps[-1][1]
        out["top_costly_queries" + suffix] = with_tables("audit", _events(700, project, kind="query"), LATEST, ("c", pairs), select=
            f"SELECT query, n AS queryCount, {ladder('b')}, {r2(cost('b', '5'))} AS onDemandCost FROM c")
        source = "config_labels" if literal else "coalesce(config_labels, job_labels)"
        out["top_billed_labels" + suffix] = with_tables("audit", _events(7, project), LATEST,
            ("u", f"SELECT * FROM (SELECT {BYTES0} AS b, unnest({source}) AS l FROM d) WHERE l.key IS NOT NULL AND l.value IS NOT NULL"), select=f"""
SELECT l.key AS labelKey, l.value AS labelValue, CAST(sum(b) AS BIGINT) AS totalBilledBytes, {r2('CAST(sum(b) AS DOUBLE) / 1048576')} AS totalMegabytesBilled,
  {r2('CAST(sum(b) AS DOUBLE) / 1099511627776')} AS totalTerabytesBilled, {r2(cost('sum(b)', '5'))} AS onDemandCost FROM u GROUP BY l.key, l.value""")
        billed = _events(7, project, kind="query", tests="query IS NOT NULL AND total_bytes_billed IS NOT NULL AND project_id IS NOT NULL")
        billed_columns = f"""
SELECT usr AS "user", ts AS "timestamp", {A_IDS}, {r2(cost(BYTES0, '5', per))} AS onDemandCost, {ladder('total_bytes_billed')},
  total_bytes_billed AS totalBilledBytes, query"""
        out["top_billed_queries" + suffix] = with_tables("audit", billed, select=billed_columns + " FROM src")
        for unit in ("day", "hour", "minute", "second"):
            out[f"slots_by_{unit}" + suffix] = _audit_slots(unit, project, None, literal)
        if literal:
            continue
        out["top_billed_queries_deduplicated"] = with_tables("audit", billed, LATEST, select=billed_columns +
            f", {r2(slots())} AS approximateSlotCount FROM d WHERE {slots()} IS NOT NULL")
        out["top_complex_queries"] = with_tables("audit", _events(5, project, kind="query"), LATEST, select=f"""
SELECT {r2(slots())} AS approximateSlotCount, usr AS "user", query, {A_IDS}, total_bytes_billed AS totalBilledBytes,
  {r2(cost('total_bytes_billed', '5'))} AS onDemandCost, total_slot_ms AS totalSlotMs, {ms()} AS executionTimeMs FROM d WHERE {slots()} IS NOT NULL""")
        out["top_cost_users"] = with_tables("audit", _events(5, project, kind="query"), LATEST,
            ("c", f"SELECT usr, CAST({r2(cost('total_bytes_billed', '5'))} AS DECIMAL(18,2)) AS c FROM d"),
            select='SELECT usr AS "user", CAST(sum(c) AS DOUBLE) AS onDemandCost FROM c WHERE c > 0 GROUP BY usr')
        out["table_query_counts"] = with_tables("audit", _events(700, project), LATEST, select="""
SELECT usr AS "user", t.project_id AS projectId, t.dataset_id AS datasetId, t.table_id AS tableId, count(t.table_id) AS jobCount
FROM (SELECT usr, unnest(referenced_tables) AS t FROM d) GROUP BY ALL""")
        for unit in ("minute", "second"):
            out[f"concurrent_queries_by_{unit}"] = with_tables("audit", _events(7, project, kind="query", tests=NO_CONFIG, also=STARTED),
                ("x", _alive(unit, "src")), select=f'SELECT count(*) AS jobCounter, tick AS "{unit}" FROM x GROUP BY tick')
            out[f"load_slots_per_{unit}"] = _audit_slots(unit, project, "load", False)
            out[f"query_slots_per_{unit}"] = _audit_slots(unit, project, "query", False)
        out["slots_by_minute_and_user"] = _audit_slots("minute", project, None, False, by_user=True)
        score = lambda test, yes, no: f"(CASE WHEN {test} THEN {yes} ELSE {no} END)::DOUBLE"
        out["billing_recommendations_per_query"] = with_tables("audit", _events(7, project, kind="query"),
            ("r", f"SELECT *, {slots()} AS s, {r2(cost(BYTES0, '5'))} AS c, {EVENT_TYPE} AS k, {ms()} AS m FROM src"),
            ("n", "SELECT query, count(query) AS n FROM r GROUP BY query"),
            ("z", f"""SELECT r.*, c * 100 + {score("k = 'QUERY'", 100, 200)} + {score('m > 60000', 100, 200)} + {score('s > 500', 500, 100)}
  + n * c * (-0.1)::DOUBLE + {score("k IN ('LOAD', 'TABLE COPY', 'EXTRACT')", 100, 0)} AS od,
  c * 125 + {score("k = 'QUERY'", 200, 100)} + {score('m > 60000', 200, 100)} + {score('s > 200', 100, 500)} + n * 0.1::DOUBLE * c AS fr
FROM r JOIN n ON r.query = n.query"""),
            select=f"""
SELECT query, CASE WHEN od > fr THEN 'On Demand' ELSE 'Flat Rate' END AS recommendedBilling,
  {r2('CASE WHEN od > fr THEN od / NULLIF(fr, 0) ELSE fr / NULLIF(od, 0) END')} AS recommendedBillingRatio, project_id AS projectId,
  start_time AS startTime, end_time AS endTime, s AS approximateSlotCount, c AS onDemandCost, {ladder('total_bytes_billed')} FROM z""")
    return out


def _audit_slots(unit: str, project: str | None, kind: str | None, literal: bool, by_user: bool = False) -> str:
    user = 'usr AS "user", ' if by_user else ""
    return with_tables("audit", _events(7, project, kind=kind, tests=NO_CONFIG, also=STARTED), LATEST,
        ("s", f"SELECT *, {nano('total_slot_ms', ms())} AS nano FROM d"),
        ("x", _alive(unit, "s", aligned=not literal)), select=f"""
SELECT tick AS "{unit}", {user}{EVENT_TYPE} AS eventType, CAST(sum(nano) AS DOUBLE) / 1e9 AS slotCount FROM x WHERE nano IS NOT NULL GROUP BY ALL""")


def _audit_unscoped() -> dict[str, str]:
    out = {}
    out["jobs_in_regions"] = with_tables("audit", _events(0, None, tests="TRUE", since=f"ts BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}"), select="""
SELECT project_id, location, upper(replace(event_name, '_job_completed', '')) AS job_type, count(3) AS job_type_counter FROM src GROUP BY ALL""")
    for literal in (False, True):
        suffix = "__literal" if literal else ""
        a, b = (ms(), "total_slot_ms") if literal else ("total_slot_ms", ms())
        out["slot_usage_by_billing_project_and_project" + suffix] = with_tables("audit",
            _events(7, None, kind="query", tests="dry_run IS NULL AND query IS NOT NULL AND total_bytes_billed IS NOT NULL", also=STARTED), LATEST,
            ("x", f"SELECT project_id, {nano(a, b)} AS nano, unnest(referenced_tables) AS t FROM d"), select=f"""
SELECT project_id AS billingProjectId, t.project_id AS projectId, t.dataset_id AS datasetId, t.table_id AS tableId,
  {r2('CAST(sum(nano) AS DOUBLE) / 1e9')} AS slotUsage FROM x GROUP BY ALL""")
        per = 30 if literal else 40
        out["top_cost_user_by_region_and_project" + suffix] = with_tables("audit", _events(5, None, kind="query"), LATEST,
            ("c", f"SELECT *, CAST({r2(cost('total_bytes_billed', '5', per))} AS DECIMAL(18,2)) AS c FROM d"), select="""
SELECT usr AS "user", location, project_id AS billingProjectId, CAST(sum(c) AS DOUBLE) AS onDemandCost FROM c WHERE c > 0 GROUP BY ALL""")
    return out


def oracle_sql() -> dict[str, str]:
    views, storage = {**_jobs(), **_timeline(), **_billing(), **_reservations()}, _storage()
    used = "table_storage_by_most_recently_queried"
    scoped = {n: sql for n, sql in views.items() if "__" not in n and n not in WITHOUT_PROJECT} | {used: storage[used]}
    out = views | storage | {f"{n}__project": of_project(sql, PROJECT) for n, sql in scoped.items()}
    for name, sql in _audit_unscoped().items():
        out[f"audit_{name}"] = sql
    for general, project in (("", PROJECT), ("_general", None)):
        for name, sql in _audit_scoped(project).items():
            stem, _, literal = name.partition("__")
            out[f"audit_{stem}{general}" + (f"__{literal}" if literal else "")] = sql
    limited = {f"{name}__limit": f"SELECT * FROM ({out[name]}) ORDER BY {order} LIMIT {LIMIT}" for name, order in FIRST_ROWS.items()}
    return out | limited
