"""Reports on small hand-made inputs with worked answers."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from slotwise import Warehouse
from slotwise.operators import collecting
from slotwise.operators.timeseries import alive_per_tick
from slotwise.plans import billing, concurrency, jobs, reservations, slots, storage
from tests.helpers import frame, texts, utc

AS_OF = "2024-01-31 00:00:00"
GIB, TIB = 2**30, 2**40


def warehouse(spark, **tables):
    return Warehouse.from_frames(spark, {n: frame(spark, n, rows) for n, rows in tables.items()})


def job(**changes):
    base = {
        "job_id": "j1", "creation_time": utc("2024-01-30 10:00:00"), "start_time": utc("2024-01-30 10:00:01"),
        "end_time": utc("2024-01-30 10:00:11"), "state": "DONE", "job_type": "QUERY", "query": "q",
        "total_slot_ms": 50_000, "total_bytes_billed": TIB, "user_email": "u@example.com", "project_id": "p",
        "statement_type": "SELECT",
    }
    return {**base, **changes}


def test_general_job_information(spark):
    wh = warehouse(spark, jobs=[
        job(), job(end_time=utc("2024-01-30 10:00:06"), total_slot_ms=1),  # an older version
        job(job_id="j2", reservation_id="a:US.r", total_bytes_billed=None, end_time=utc("2024-01-30 10:00:01")),
        job(job_id="j3", state="RUNNING"), job(job_id="j4", total_slot_ms=None),
        job(job_id="j5", creation_time=utc("2024-01-23 23:59:59")),
    ])
    df = jobs.general_job_information(wh, as_of=AS_OF).orderBy("jobId")
    got = df.select("jobId", "queryBillingType", "totalTerabytesBilled", "onDemandCost", "approximateSlotCount")
    assert [tuple(r) for r in got.collect()] == [
        ("j1", "On-Demand", 1.0, 6.25, 5.0), ("j2", "Editions", 0.0, None, None),
    ]
    assert df.columns == [
        "user", "jobType", "reservationId", "queryBillingType", "query", "jobId", "projectId", "startTime",
        "endTime", "totalBytesBilled", "totalMegabytesBilled", "totalGigabytesBilled", "totalTerabytesBilled",
        "totalSlotMs", "onDemandCost", "approximateSlotCount",
    ]


def test_query_counts_and_costs(spark):
    runs = [job(job_id=f"a{i}", query="a") for i in range(3)] + [job(job_id="b", query="b")]
    wh = warehouse(spark, jobs=[*runs, runs[0], job(job_id="n", query=None)])

    def rows(df):
        return {r.query: (r.queryCount, r.onDemandCost) for r in df.collect()}

    assert rows(jobs.query_counts(wh, as_of=AS_OF)) == {"a": (3, 15.0), "b": (1, 5.0)}
    assert rows(jobs.query_counts(wh, as_of=AS_OF, literal=True)) == {"a": (9, 15.0), "b": (1, 5.0)}
    assert rows(jobs.top_costly_queries(wh, as_of=AS_OF)) == {"a": (3, 18.75), "b": (1, 6.25)}
    assert rows(jobs.top_costly_queries(wh, as_of=AS_OF, literal=True)) == {"a": (6, 37.5)}


def test_labels_are_unfolded_after_deduplication(spark):
    labels = [{"key": "team", "value": "x"}, {"key": "env", "value": "prod"}, {"key": "no", "value": None}]
    wh = warehouse(spark, jobs=[job(labels=labels), job(labels=labels), job(job_id="e", labels=[])])

    def rows(**kw):
        df = jobs.top_billed_labels(wh, as_of=AS_OF, **kw)
        return {(r.labelKey, r.labelValue): r.totalBilledBytes for r in df.collect()}

    assert rows() == {("team", "x"): TIB, ("env", "prod"): TIB}
    assert rows(literal=True) == {("env", "prod"): TIB}


def test_rank_before_deduplication_can_lose_a_text(spark):
    old = job(total_bytes_billed=9 * TIB, end_time=utc("2024-01-30 10:00:05"))
    wh = warehouse(spark, jobs=[job(), old])
    assert jobs.top_billed_queries_deduplicated(wh, as_of=AS_OF).count() == 1
    assert jobs.top_billed_queries_deduplicated(wh, as_of=AS_OF, literal=True).count() == 0


def test_sums_beyond_64_bits_of_bytes(spark):
    wh = warehouse(spark, jobs=[job(job_id=f"j{i}", total_bytes_billed=2**62) for i in range(4)])
    assert jobs.top_cost_users(wh, as_of=AS_OF).first().onDemandCost == 2**64 / TIB * 6.25


def second(at, ms=1000, **changes):
    base = {
        "period_start": utc(at), "period_slot_ms": ms, "job_id": "j1", "job_type": "QUERY", "state": "RUNNING",
        "statement_type": "SELECT", "job_creation_time": utc("2024-01-30 10:00:00"), "user_email": "u",
        "reservation_id": "admin:US.r", "edition": "ENTERPRISE_PLUS",
    }
    return {**base, **changes}


def test_slots_by_day_in_local_days(spark):
    wh = warehouse(spark, jobs_timeline=[
        second("2024-01-30 07:59:59", 86_400_000), second("2024-01-30 08:00:00", 43_200_000),
        second("2024-01-30 09:00:00", 1, statement_type="SCRIPT"), second("2024-01-30 09:00:00", 1, statement_type=None),
    ])
    df = slots.slots_by_day(wh, as_of=AS_OF)
    rows = texts(df)
    assert len(rows) == 8
    assert rows[-1] == (0.5, "2024-01-30 00:00:00") and rows[-2] == (1.0, "2024-01-29 00:00:00")
    assert df.columns == ["slot_usage", "timeInterval_PST"]
    more = slots.slots_by_day(wh, as_of=AS_OF, include_null_type=True).collect()
    assert more[-1].slot_usage > 0.5


def test_day_buckets_after_an_offset_change(spark):
    rows = [second("2026-03-09 12:00:00", 86_400_000), second("2026-03-07 12:00:00", 86_400_000)]
    wh = warehouse(spark, jobs_timeline=rows)
    fixed = slots.slots_by_day(wh, as_of="2026-03-10 12:00:00", days=4)
    drifting = slots.slots_by_day(wh, as_of="2026-03-10 12:00:00", days=4, literal=True)
    assert sum(r.slot_usage for r in fixed.collect()) == 2.0
    assert sum(r.slot_usage for r in drifting.collect()) == 1.0


def test_slots_by_user_has_one_empty_row_per_idle_minute(spark):
    wh = warehouse(spark, jobs_timeline=[second("2024-01-30 10:00:00", 60_000), second("2024-01-30 10:00:30", 60_000, user_email="v")])
    rows = slots.slots_by_minute_and_user(wh, as_of=AS_OF, days=1).collect()
    assert len(rows) == 1441 + 1
    assert sorted((r.user_email, r.slot_usage) for r in rows if r.user_email) == [("u", 1.0), ("v", 1.0)]


def test_concurrent_queries_count_each_bucket(spark):
    wh = warehouse(spark, jobs_timeline=[
        second("2024-01-30 10:00:01"), second("2024-01-30 10:00:02"), second("2024-01-30 10:01:00"),
        second("2024-01-30 10:00:01", job_id="j2"), second("2024-01-30 10:00:01", job_id="c", parent_job_id="j2"),
    ])
    mine = concurrency.concurrent_queries_by_minute(wh, as_of=AS_OF)
    assert [r.job_count for r in mine.collect()] == [2, 1]
    once = concurrency.concurrent_queries_by_minute(wh, as_of=AS_OF, literal=True)
    assert [r.job_count for r in once.collect()] == [2]


def test_costs_by_query(spark):
    wh = warehouse(spark, jobs=[
        job(), job(job_id="j2", total_bytes_billed=0), job(job_id="n", query=None),
    ])
    rows = {r.onDemandCost: r for r in billing.costs_by_query(wh, as_of=AS_OF).collect()}
    dear, cheap = rows[6.25], rows[10 * 2**20 / TIB * 6.25]
    assert (dear.executionCount, dear.billedSlotCount, dear.slotHours) == (2, 50.0, 50 / 60)
    assert (cheap.billedBytes, cheap.billedMegabytes, cheap.billedGigabytes) == (10485760.0, 10.0, 0.01)
    literal = billing.costs_by_query(wh, as_of=AS_OF, literal=True).collect()
    assert min(r.billedGigabytes for r in literal) == 10 / 1024


def test_billing_recommendation_counts_slots(spark):
    # 5 slots step up to 50; a minute at 0.06 is 0.05, ten MiB on demand far less.
    wh = warehouse(spark, jobs=[job(total_bytes_billed=GIB)])
    fixed = billing.billing_recommendation_per_query(wh, as_of=AS_OF).first()
    assert fixed.enterpriseEditionCost == pytest.approx(50 / 60 * 0.06)
    assert fixed.enterpriseEditionRecommendation == "On-demand"
    literal = billing.billing_recommendation_per_query(wh, as_of=AS_OF, literal=True).first()
    assert literal.enterpriseEditionCost == pytest.approx(1 / 60 * 0.06)
    assert literal.enterpriseEditionRecommendation == "Enterprise Edition"


def test_total_billing_recommendation(spark):
    wh = warehouse(
        spark,
        jobs=[job(), job(job_id="j2", total_bytes_billed=None), job(job_id="j3", total_bytes_billed=0, query=None)],
        jobs_timeline=[second("2024-01-30 10:00:00", 3_000_000), second("2024-01-30 10:00:30", 3_000_000)],
    )
    rows = {r.baseline_slots: r for r in billing.total_billing_recommendation(wh, as_of=AS_OF).collect()}
    assert sorted(rows) == [0, 50, 100, 200, 500, 1000]
    # 100 slots in one minute: nothing committed, 100 slot-minutes autoscaled.
    assert rows[0].enterprise_payg_cost == round(100 / 60 * 0.06, 2)
    assert rows[50].enterprise_3yr_cost == round(50 * 720 * 0.036 + 50 / 60 * 0.06, 2)
    assert (rows[0].total_unique_queries, rows[0].total_query_executions) == (1, 3)
    assert rows[0].total_on_demand_cost == 6.25
    empty = billing.total_billing_recommendation(
        warehouse(spark, jobs=[job()], jobs_timeline=[second("2020-01-01 00:00:00")]), as_of=AS_OF
    )
    assert [r.standard_total_cost for r in empty.collect()] == [None] * 6


def reserved(**changes):
    base = {
        "period_start": utc("2024-01-30 10:00:00"), "reservation_name": "r", "reservation_id": "admin:US.r",
        "edition": "ENTERPRISE_PLUS", "slots_assigned": 100, "slot_capacity": 100,
        "period_autoscale_slot_seconds": 3600, "autoscale": {"current_slots": 50, "max_slots": 200},
        "per_second_details": [
            {"start_time": utc("2024-01-30 10:00:00"), "autoscale_current_slots": 50, "autoscale_max_slots": 200,
             "slots_assigned": 100, "slots_max_assigned": 100},
            {"start_time": utc("2024-01-30 10:00:01"), "autoscale_current_slots": 0, "autoscale_max_slots": 0,
             "slots_assigned": 100, "slots_max_assigned": 100},
        ],
    }
    return {**base, **changes}


def test_autoscale_costs(spark):
    wh = warehouse(spark, reservations_timeline=[reserved()])
    newest, oldest = reservations.autoscale_usage_and_costs_per_second(wh, as_of=AS_OF).collect()
    assert newest.autoscale_usage_ratio is None and oldest.autoscale_usage_ratio == 0.25
    assert float(oldest.total_slots_cost) == pytest.approx(150 * 0.000027778)
    assert (oldest.slots_assigned, oldest.total_slots_cost_formatted) == (100, "$ 0.00")
    literal = reservations.autoscale_usage_and_costs_per_second(wh, as_of=AS_OF, literal=True).first()
    assert (literal.slots_assigned_cost, literal.total_slots_cost) == (100, None)


def test_utilization(spark):
    wh = warehouse(
        spark,
        reservations_timeline=[
            reserved(), reserved(period_start=utc("2024-01-30 10:01:00")),
            reserved(period_start=utc("2024-01-30 10:02:00"), autoscale={"current_slots": 0, "max_slots": 0}),
            reserved(reservation_name="other", reservation_id="admin:US.other"),
        ],
        jobs_timeline=[second("2024-01-30 10:00:00", 600_000), second("2024-01-30 10:00:01", 600_000),
                       second("2024-01-30 10:00:01", 300_000, job_id="j2"), second("2024-01-30 10:00:01", None, job_id="j3")],
    )
    rows = reservations.bqe_slot_utilization_by_minute(wh, as_of=AS_OF, reservation_name="r").collect()
    assert [(r.active_jobs_per_period, r.slots_per_period, r.utilization_pct) for r in rows] == [
        (0, 0.0, 0.0), (0, 0.0, 0.0), (2, 25.0, 50.0),
    ]
    literal = reservations.bqe_slot_utilization_by_minute(wh, as_of=AS_OF, reservation_name="r", literal=True)
    assert [r.utilization_pct for r in literal.collect()] == [0.0, None, 50.0]


@pytest.mark.parametrize("n", [1, 60, 50_000])
def test_each_job_of_a_second_is_a_row_whatever_their_number(spark, n):
    wh = warehouse(spark, reservations_timeline=[reserved()], jobs_timeline=[second("2024-01-30 10:00:00")])
    crowd = wh.jobs_timeline.crossJoin(spark.range(n)).withColumn("job_id", F.concat(F.lit("j"), "id")).drop("id")
    odd = warehouse(spark, jobs_timeline=[
        second("2024-01-30 10:00:01", job_id="lone"), second("2024-01-30 10:00:01", job_id="s", statement_type="SCRIPT")]).jobs_timeline
    wh = Warehouse.from_frames(spark, {"reservations_timeline": wh.reservations_timeline, "jobs_timeline": crowd.unionByName(odd)})
    flat = reservations.queries_and_reservation_usage_per_second(wh, as_of=AS_OF)
    assert flat.count() == n + 1 and flat.filter("job_id = 's'").isEmpty()
    assert flat.first().editions_cost == pytest.approx(0.000027778)
    listed = reservations.queries_and_reservation_usage_per_second(wh, as_of=AS_OF, literal=True)
    assert [r.n for r in listed.select(F.size("jobs").alias("n")).collect()] == [1, n]


def test_seconds_meet_their_jobs_as_in_a_join(spark):
    """Repeated slots and jobs, names that are null, and seconds that only one side knows."""
    wh = warehouse(
        spark,
        reservations_timeline=[reserved(), reserved(), reserved(reservation_name=None, reservation_id=None), reserved(reservation_name="other", edition=None),
                               reserved(period_start=utc("2024-01-30 11:00:00"), per_second_details=[{"start_time": None}])],
        jobs_timeline=[second("2024-01-30 10:00:00", job_id=k, period_slot_ms=ms) for k, ms in (("b", 2), ("a", None), ("a", None), ("c", 1))]
        + [second("2024-01-30 10:00:01", job_id="d", reservation_id="admin:US.other"), second("2024-01-30 10:00:01", job_id="e", reservation_id=None),
           second("2024-01-30 10:00:02", job_id="f"), second("2024-01-30 10:00:01", job_id="g", reservation_id="admin:US.third")],
    )
    df = reservations.queries_and_reservation_usage_per_second(wh, as_of=AS_OF, literal=True)
    assert df.columns == ["start_time", "reservation_name", "edition", "autoscale_current_slots", "autoscale_max_slots", "slots_assigned", "slots_max_assigned", "jobs"]
    got = [(str(r.start_time), r.reservation_name, r.edition, r.autoscale_max_slots, [(x.job_id, x.period_slot_ms) for x in r.jobs])
           for r in df.withColumn("start_time", F.date_format("start_time", "HH:mm:ss")).collect()]
    jobs_of_r = [("a", None), ("a", None), ("c", 1), ("b", 2)]
    assert got == [("10:00:01", "other", None, 0, [("d", got[0][4][0][1])]), *[("10:00:00", "r", "ENTERPRISE_PLUS", 200, jobs_of_r)] * 2]


def test_planning_runs_no_job(spark):
    wh = warehouse(spark, reservations_timeline=[reserved()], jobs_timeline=[second("2024-01-30 10:00:00")])
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        reservations.bqe_slot_utilization_by_minute(wh, as_of=AS_OF, reservation_name="r")
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("planning") == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_seconds_of_jobs_created_before_the_look_back_stay_out(spark):
    early = second("2024-01-24 00:00:00", job_creation_time=utc("2024-01-23 23:59:59"))
    same = second("2024-01-24 00:00:00", job_id="in", job_creation_time=utc("2024-01-24 00:00:00.5"))
    wh = warehouse(spark, reservations_timeline=[reserved(period_start=utc("2024-01-24 00:00:00")), reserved(period_start=utc("2024-01-24 00:01:00"))],
                   jobs_timeline=[early, same])
    rows = reservations.bqe_slot_utilization_by_minute(wh, as_of=AS_OF, reservation_name="r").collect()
    assert [r.active_jobs_per_period for r in rows] == [0]
    counted = concurrency.concurrent_queries_by_second(wh, as_of="2024-01-31 08:00:00", days=8)
    assert [r.job_count for r in counted.collect()] == [2]


def test_sums_pass_64_bits(spark):
    big = 2**62
    labels = [{"key": "k", "value": "v"}]
    wh = warehouse(spark, jobs=[job(job_id=f"b{i}", total_bytes_billed=big, labels=labels) for i in range(4)])
    assert int(jobs.top_billed_labels(wh, as_of=AS_OF).first().totalBilledBytes) == 4 * big
    texts = spark.createDataFrame([("t", 4_000_000_000)], "query string, runs bigint").withColumn("bytes", F.lit(10).cast("decimal(30,0)"))
    row = jobs._costly(texts, 5.0, True).first()
    assert int(row.queryCount) == 4_000_000_000 * 3_999_999_999
    spans = spark.createDataFrame([(utc("2024-01-30 10:00:00"), utc("2024-01-30 10:00:01"), big)] * 4, "a timestamp, b timestamp, v bigint")
    level = alive_per_tick(spans, "a", "b", "second", name="t", measure=F.col("v")).first()
    assert int(level.measure) == 4 * big


def test_reservation_costs_with_commitments(spark):
    wh = warehouse(
        spark,
        reservations_timeline=[reserved(edition=None) for _ in range(6)],
        reservations=[{"reservation_name": "r", "edition": "ENTERPRISE"}],
        capacity_commitments=[
            {"edition": "ENTERPRISE", "commitment_plan": "ANNUAL", "slot_count": 100, "state": "ACTIVE"},
            {"edition": "ENTERPRISE", "commitment_plan": "MONTHLY", "slot_count": 100, "state": "ACTIVE"},
            {"edition": "ENTERPRISE", "commitment_plan": "ANNUAL", "slot_count": 900, "state": "PENDING"},
        ],
    )
    row = reservations.reservation_cost_per_day(wh, as_of=AS_OF).first()
    assert (row.total_baseline_slot_hours, row.total_autoscale_slot_hours) == (10.0, 6.0)
    assert row.daily_baseline_cost == pytest.approx(10 * (0.048 + 0.06) / 2)
    assert row.daily_autoscale_cost == 0.36
    literal = reservations.reservation_cost_per_day(wh, as_of=AS_OF, literal=True).first()
    assert literal.daily_baseline_cost == pytest.approx(0.24)


def stored(**changes):
    base = {
        "project_id": "p", "table_schema": "d", "table_name": "t", "deleted": False, "total_rows": 1,
        "total_partitions": 0, "total_logical_bytes": 1100 * GIB, "active_logical_bytes": 1000 * GIB,
        "long_term_logical_bytes": 100 * GIB, "total_physical_bytes": 110 * GIB, "active_physical_bytes": 100 * GIB,
        "long_term_physical_bytes": 10 * GIB, "time_travel_physical_bytes": 20 * GIB, "fail_safe_physical_bytes": 5 * GIB,
    }
    return {**base, **changes}


def table(**changes):
    base = {"table_catalog": "p", "table_schema": "d", "table_name": "t", "table_type": "BASE TABLE"}
    return {**base, **changes}


def test_storage_prices_per_table(spark):
    wh = warehouse(
        spark,
        table_storage=[stored(), stored(table_schema="e"), stored(table_name="gone", deleted=True)],
        tables=[table(), table(table_name="gone")],
    )
    (row,) = storage.project_per_table_storage_model_recommendations(wh).collect()
    assert row.logical_storage_price == "$ 21.00"
    assert row.base_physical_price == "$ 3.20"  # without 20 GiB of time travel
    assert row.additional_costs_for_physical_storage == "$ 1.00"
    assert row.physical_storage_price == "$ 4.40" and row.recommendation == "Physical storage"
    # Published form: any dataset with a table of the name will do.
    assert storage.project_per_table_storage_model_recommendations(wh, literal=True).count() == 2


def test_storage_model_per_dataset(spark):
    wh = warehouse(
        spark,
        table_storage=[stored(), stored(table_schema="e", active_logical_bytes=GIB, long_term_logical_bytes=0)],
        tables=[table(), table(table_schema="e")],
        schemata_options=[
            {"schema_name": "e", "option_name": "storage_billing_model", "option_value": "PHYSICAL"},
            {"schema_name": "e", "option_name": "default_table_expiration_days", "option_value": "30"},
        ],
    )
    rows = {r.dataset: r for r in storage.project_storage_model_recommendation(wh).collect()}
    assert rows["p.d"].current_storage_model == "LOGICAL"
    assert "'PHYSICAL'" in rows["p.d"].recommendation_change_SQL
    assert "`p.e`" in rows["p.e"].recommendation_change_SQL and "'LOGICAL'" in rows["p.e"].recommendation_change_SQL


def test_tables_by_last_query(spark):
    refs = [{"project_id": "p", "dataset_id": "d", "table_id": "t"}]
    wh = warehouse(
        spark,
        jobs=[job(referenced_tables=refs), job(job_id="j2", referenced_tables=refs, creation_time=utc("2024-01-30 11:00:00.25")),
              job(job_id="l", job_type="LOAD", referenced_tables=refs, creation_time=utc("2024-01-30 12:00:00"))],
        table_storage=[stored(), stored(table_name="idle")],
        tables=[table(), table(table_name="idle", table_type="VIEW")],
        table_options=[{"table_catalog": "p", "table_schema": "d", "table_name": "t",
                        "option_name": "storage_billing_model", "option_value": "PHYSICAL"}],
    )
    idle, used = storage.table_storage_by_most_recently_queried(wh, as_of=AS_OF).collect()
    assert idle.last_queried_time == "Prior to 2024-01-17 00:00:00+00"
    assert used.last_queried_time == "2024-01-30 11:00:00.250+00"
    assert (used.storage_billing_model, used.readable_total_billed_size) == ("PHYSICAL", "110.00 GiB")
    assert (idle.table_storage_price, used.table_storage_price) == ("$ 21.00", "$ 4.20")


def test_usage_per_day(spark):
    day = datetime(2024, 1, 30).date()
    usage = {"usage_date": day, "project_id": "p", "table_schema": "d", "table_name": "t",
             "billable_active_logical_usage": 10**6 * GIB, "billable_long_term_physical_usage": GIB}
    old = {**usage, "usage_date": day - timedelta(days=7)}
    wh = warehouse(spark, table_storage_usage=[usage, usage, old])
    (row,) = storage.table_usage_and_costs_per_day(wh, as_of=AS_OF).collect()
    assert row.billable_active_logical_usage_in_gibytes == 2e6
    assert row.active_logical_pretty_cost == "$ 54.79"
    names = storage.table_usage_and_costs_per_day(wh, as_of=AS_OF).columns
    assert len(names) == len(set(names)) == 4 + 6 * 2 + 4 * 2


def test_as_of_may_carry_a_zone(spark):
    wh = warehouse(spark, jobs=[job()])
    moment = datetime(2024, 1, 30, 16, tzinfo=timezone(timedelta(hours=-8)))
    assert jobs.general_job_information(wh, as_of=moment).count() == 1
    assert jobs.general_job_information(wh, as_of="2024-01-30 09:00:00").count() == 0
    assert wh.jobs.filter(F.col("job_id") == "j1").count() == 1


def test_lists_are_cut_to_their_first_rows(spark):
    rows = [job(job_id=f"j{k}", query=f"q{k % 7}", total_bytes_billed=k * 2**40) for k in range(30)]
    wh = warehouse(spark, jobs=rows)
    for report in (jobs.top_billed_queries, jobs.top_costly_queries, jobs.query_counts, jobs.longest_running_queries):
        every = texts(report(wh, as_of=AS_OF))
        assert texts(report(wh, as_of=AS_OF, limit=5)) == every[:5] and len(every) > 5
        assert texts(report(wh, as_of=AS_OF, limit=1000)) == every
    refs = [job(job_id=f"j{k}", referenced_tables=[("p", "d", f"t{k % 3}")] * (k % 5)) for k in range(20)]
    counts = sorted((-r[4], r[3]) for r in texts(jobs.table_query_counts(warehouse(spark, jobs=refs), as_of=AS_OF)))
    first = texts(jobs.table_query_counts(warehouse(spark, jobs=refs), as_of=AS_OF, limit=2))
    assert [(-r[4], r[3]) for r in first] == counts[:2]


def test_jobs_without_a_statement_type_are_an_option(spark):
    rows = [job(job_id=f"{kind}", statement_type=kind, creation_time=utc("2024-01-30 10:00:00"), start_time=utc("2024-01-30 10:00:00"),
                end_time=utc("2024-01-30 10:05:00")) for kind in ("SELECT", None, "SCRIPT")]
    wh = warehouse(spark, jobs=rows)
    report = concurrency.concurrent_queued_and_running_jobs_per_minute
    most = [max(r[1] for r in texts(report(wh, as_of=AS_OF, **kw))) for kw in ({}, {"include_null_type": True})]
    assert most == [1, 2]


def test_sketches_count_within_their_error_and_roll_up(spark):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-30 10:00:00")) + F.col("id") % 7200)
    timeline = spark.range(60_000).select(
        F.concat(F.lit("job"), (F.col("id") % 40_000).cast("string")).alias("job_id"), at.alias("period_start"), at.alias("job_creation_time"),
        F.lit("QUERY").alias("job_type"), F.lit("PENDING").alias("state"), F.lit(None).cast("string").alias("parent_job_id"), F.lit("p").alias("project_id"),
    )
    wh = Warehouse.from_frames(spark, {"jobs_timeline": timeline})
    exact = texts(concurrency.concurrent_queries_by(wh, "hour", as_of=AS_OF))
    about = texts(concurrency.concurrent_queries_by(wh, "hour", as_of=AS_OF, approximate=True))
    assert len(exact) == 2 and [r[0] for r in exact] == [r[0] for r in about]
    assert all(abs(a - e) <= 0.05 * e for (_, e), (_, a) in zip(exact, about, strict=True))
    minutes = concurrency.job_sketches(wh, "minute", as_of=AS_OF)
    hours = concurrency.estimated_distinct(concurrency.rolled_up(minutes, "hour"), "jobs", "job_count").orderBy("period_start")
    assert all(abs(a - e) <= 0.05 * e for (_, e), (_, a) in zip(exact, texts(hours), strict=True))
    queued = [texts(concurrency.queued_queries_by_second(wh, as_of=AS_OF, approximate=flag)) for flag in (False, True)]
    assert queued[0] == queued[1] and len(queued[0]) == 7200  # few jobs a second
    with pytest.raises(ValueError):
        concurrency.concurrent_queries_by(wh, "minute", as_of=AS_OF, literal=True, approximate=True)


def test_arrays_of_a_crowded_second_are_gathered_from_parts(spark):
    rows = spark.range(50_000).select(
        F.lit("second").alias("k"), F.struct((F.col("id") * 7919 % 50_000).alias("ms"), F.concat(F.lit("j"), "id").alias("job_id")).alias("job")
    )
    rows = rows.unionByName(spark.range(3).select(F.lit(None).cast("string").alias("k"), F.struct(F.col("id").alias("ms"), F.lit("x").alias("job_id")).alias("job")))
    found = collecting.collected(rows, ["k"], "job", F.col("job.job_id"), name="jobs")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 2 and plan.count("partial_collect_list") == 2
    got = {r.k: [x.ms for x in r.jobs] for r in found.collect()}
    assert got == {"second": list(range(50_000)), None: [0, 1, 2]}
    parts = rows.groupBy("k", F.pmod(F.xxhash64("job.job_id"), F.lit(collecting.PARTS))).count().filter("k = 'second'")
    assert parts.count() == collecting.PARTS and parts.agg(F.max("count")).first()[0] < 2_500
