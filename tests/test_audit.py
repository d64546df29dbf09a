"""The nested log: flattening, validity, intervals and scores."""

import pytest
from pyspark.sql import functions as F

from slotwise import Warehouse
from slotwise.operators.audit import flatten, recent_events, valid_events
from slotwise.plans import audit
from tests.helpers import frame, utc

AS_OF = "2024-01-31 00:00:00"
TIB = 2**40


def event(
    job_id="j1", kind="query", user="u@example.com", project="p", query="q", dry=None, config=True,
    at="2024-01-30 10:00:10", start="2024-01-30 10:00:00", end="2024-01-30 10:00:10",
    slot_ms=20_000, nbytes=TIB, labels=None, job_labels=None, refs=None, location="US", name=None,
):
    load = {"sourceUris": ["gs://b/x"], "destinationTable": {"projectId": "p", "datasetId": "d", "tableId": "t"}}
    configuration = {
        "query": {"query": query} if kind == "query" and query else None,
        "load": load if kind == "load" else None,
        "extract": None, "tableCopy": None, "dryRun": dry, "labels": labels,
    }
    job = {
        "jobName": {"jobId": job_id, "location": location, "projectId": project},
        "jobConfiguration": configuration if config else None,
        "jobStatistics": {
            "startTime": utc(start), "endTime": utc(end), "totalBilledBytes": nbytes,
            "totalProcessedBytes": nbytes, "totalSlotMs": slot_ms, "referencedTables": refs,
        },
        "labels": job_labels,
    }
    return {
        "timestamp": utc(at),
        "protopayload_auditlog": {
            "authenticationInfo": {"principalEmail": user},
            "servicedata_v1_bigquery": {"jobCompletedEvent": {"eventName": name or f"{kind}_job_completed", "job": job}},
        },
    }


def log(spark, *events):
    return Warehouse.from_frames(spark, {"audit_log": frame(spark, "audit_log", events)})


def ids(df):
    return sorted(r.jobId for r in df.collect())


def test_flattening_recovers_the_job_rows(warehouse):
    flat = flatten(warehouse.audit_log)
    back = flat.select(
        F.coalesce("endTime", "timestamp").alias("t"), "totalSlotMs", "totalBilledBytes", F.size("referencedTables")
    )
    jobs = warehouse.jobs.select(
        F.coalesce("end_time", "creation_time"), "total_slot_ms", "total_bytes_billed", F.size("referenced_tables")
    )
    assert back.exceptAll(jobs).isEmpty() and jobs.exceptAll(back).isEmpty()


def test_only_valid_events_are_kept(spark):
    wh = log(
        spark, event("ok"), event(None), event("script_job_1"), event("scriptXjobX1"), event("no_user", user=None),
        event("blank_user", user=""), event("dry", dry=True), event("no_config", config=False),
        event("no_project", project=None), event("other", name="query_job_inserted"), event("load", kind="load"),
    )
    assert ids(valid_events(wh.audit_log)) == ["load", "ok"]
    assert ids(valid_events(wh.audit_log, kind="query")) == ["ok"]
    assert ids(valid_events(wh.audit_log, config=False)) == ["load", "no_config", "ok"]
    assert ids(valid_events(wh.audit_log, dry_run=False)) == ["dry", "load", "ok"]
    assert ids(valid_events(wh.audit_log, load=True)) == ["load"]
    assert ids(valid_events(wh.audit_log, query_text=True)) == ["ok"]
    assert ids(valid_events(wh.audit_log, project_id="elsewhere")) == []


def test_window_is_whole_utc_days(spark):
    wh = log(spark, event("in", at="2024-01-24 00:00:00"), event("out", at="2024-01-23 23:59:59"), event("later", at="2024-02-02 00:00:00"))
    assert ids(recent_events(wh.audit_log, "2024-01-31 17:00:00", 7)) == ["in", "later"]


def test_slots_are_slot_time_over_run_time(spark):
    wh = log(spark, event(), event(at="2024-01-30 09:00:00", slot_ms=1))
    (row,) = audit.general_job_information(wh, as_of=AS_OF).collect()
    assert (row.approximateSlotCount, row.cost, row.eventType, row.query.query) == (2.0, 5.0, "QUERY", "q")
    (literal,) = audit.general_job_information(wh, as_of=AS_OF, literal=True).collect()
    assert literal.approximateSlotCount == 0.5


def test_price_base(spark):
    wh = log(spark, event())

    def cost(**kw):
        return audit.top_billed_queries(wh, as_of=AS_OF, **kw).first().onDemandCost

    assert cost() == cost(project_id="p") == cost(literal=True) == 5.0
    assert cost(project_id="p", literal=True) == 5.0 * 1024


def test_labels_fall_back_to_the_job(spark):
    own, job = [{"key": "a", "value": "own"}], [{"key": "a", "value": "job"}]
    wh = log(spark, event("x", labels=own, job_labels=job), event("y", job_labels=job))
    rows = {r.labelValue: r.totalBilledBytes for r in audit.top_billed_labels(wh, as_of=AS_OF).collect()}
    assert rows == {"own": TIB, "job": TIB}
    literal = audit.top_billed_labels(wh, as_of=AS_OF, literal=True)
    assert [r.labelValue for r in literal.collect()] == ["own"]


def test_query_counts(spark):
    wh = log(spark, event("a"), event("a", at="2024-01-30 09:00:00"), event("b"), event("l", kind="load"))
    (row,) = audit.query_counts(wh, as_of=AS_OF).collect()
    assert (row.queryCount, row.onDemandCost) == (2, 10.0)
    (literal,) = audit.query_counts(wh, as_of=AS_OF, literal=True).collect()
    assert literal.queryCount == 9


def test_cents_are_summed_exactly_and_nothing_is_left_out(spark):
    wh = log(spark, *[event(f"j{i}", nbytes=TIB // 50) for i in range(1000)], event("free", nbytes=0))
    (row,) = audit.top_cost_users(wh, as_of=AS_OF).collect()
    assert row.onDemandCost == 100.0


def test_aligned_ticks_meet_and_raw_ticks_do_not(spark):
    a = event("a", start="2024-01-30 10:00:40", end="2024-01-30 10:02:40", slot_ms=120_000)
    b = event("b", start="2024-01-30 10:00:10", end="2024-01-30 10:01:10", slot_ms=120_000)
    wh = log(spark, a, b, event("unknown", slot_ms=None), event("at_once", end="2024-01-30 10:00:00"))
    got = audit.slots_by_minute(wh, as_of=AS_OF).collect()
    assert [r.slotCount for r in got] == [3.0, 3.0, 1.0]
    raw = audit.slots_by_minute(wh, as_of=AS_OF, literal=True).collect()
    assert [r.slotCount for r in raw] == [2.0, 1.0, 2.0, 1.0, 1.0]


@pytest.mark.parametrize("unit", ["minute", "second"])
def test_changes_and_unfolding_agree_on_the_derived_log(warehouse, unit):
    from slotwise.operators.audit import latest_events
    from slotwise.operators.timeseries import expand_interval

    got = audit.concurrent_queries_by(warehouse, unit, as_of=AS_OF, start_within_days=None)
    events = recent_events(warehouse.audit_log, AS_OF, 7, kind="query", config=False)
    naive = (
        expand_interval(events, "startTime", "endTime", unit, aligned=True, name=unit)
        .groupBy(unit).agg(F.count("*").alias("jobCounter"))
    )
    got, naive = got.select(unit, "jobCounter"), naive.select(unit, "jobCounter")
    assert got.exceptAll(naive).isEmpty() and naive.exceptAll(got).isEmpty() and not got.isEmpty()
    assert latest_events(events).count() <= events.count()


def test_slots_by_user(spark):
    wh = log(spark, event("a", user="x"), event("b", user="y"), event("l", user="x", kind="load"))
    rows = {(r.user, r.eventType): r.slotCount for r in audit.slots_by_minute_and_user(wh, as_of=AS_OF).collect()}
    assert rows == {("x", "QUERY"): 2.0, ("y", "QUERY"): 2.0, ("x", "LOAD"): 2.0}


def test_scores(spark):
    wh = log(spark, event("a"), event("b", query="once", nbytes=0))
    rows = {r.query: r for r in audit.billing_recommendations_per_query(wh, as_of=AS_OF).collect()}
    # 500 + 200 + 200 + 100 - 0.1 * 5 against 625 + 200 + 100 + 500 + 0.1 * 5.
    assert rows["q"].recommendedBilling == "Flat Rate"
    assert rows["q"].recommendedBillingRatio == round(1425.5 / 899.5, 2)
    assert rows["once"].recommendedBillingRatio == 2.0


def test_start_window(spark):
    old = event("old", start="2024-01-29 23:00:00", end="2024-01-30 01:00:00")
    wh = log(spark, old, event("new"))
    assert audit.slots_by_hour(wh, as_of=AS_OF).count() == 1
    assert audit.slots_by_hour(wh, as_of=AS_OF, start_within_days=None).count() == 4
