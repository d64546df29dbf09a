"""Physical plans of every report on tables laid out by day."""

import re

import pytest

from checks import registry

REPORTS = sorted(registry._TIMED) + sorted(registry._SNAPSHOTS) + ["table_usage_and_costs_per_day"]
REPORTS += [f"audit_{n}" for n in (*registry._AUDIT, *registry._AUDIT_ALL)]
ALL = [n for n in registry.reports() if n.split("__")[0].removesuffix("_general") in REPORTS]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, laid_out):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return {name: plan(report(laid_out)) for name, report in registry.reports().items()}


def test_every_report_is_planned(plans):
    assert len(plans) == len(ALL) == 138 + 35 + 18 + 4 + 5


@pytest.mark.parametrize("name", [n for n in ALL if n.endswith("__project")])
def test_one_project_is_filtered_at_the_scan(plans, name):
    scans = re.findall(r"FileScan parquet .*", plans[name])
    assert any("EqualTo(project_id,proj-1)" in scan for scan in scans)


@pytest.mark.parametrize("name", ALL)
def test_no_pairwise_join_and_no_python(plans, name):
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert word not in plans[name]


@pytest.mark.parametrize("name", ALL)
def test_look_backs_skip_day_folders(plans, name):
    for scan in re.findall(r"FileScan parquet .*", plans[name]):
        if folder := re.search(r"(creation_time|timestamp|period_start)_day#|usage_date_month#", scan):
            filters = re.search(r"PartitionFilters: \[(.*?)\]", scan).group(1)
            assert folder.group() in filters and ">=" in filters, scan


@pytest.mark.parametrize("name", ALL)
def test_one_task_only_for_bounded_results(plans, name):
    """Whole-table exchanges into one task carry aggregates or a time grid only."""
    for line in plans[name].splitlines():
        if "Exchange SinglePartition" in line:
            assert name.split("__")[0] in (
                "total_billing_recommendation",
                "concurrent_queued_and_running_jobs_per_minute",
            )


def test_usage_is_cut_to_its_months_and_row_groups(plans):
    (scan,) = re.findall(r"FileScan parquet .*", plans["table_usage_and_costs_per_day"])
    assert "GreaterThanOrEqual(usage_date" in scan and "usage_date_month" in scan


@pytest.mark.parametrize("name", ["query_counts", "top_costly_queries", "audit_query_counts", "audit_top_costly_queries"])
def test_repeated_texts_are_a_hash_aggregate(plans, name):
    for form in ("", "__literal"):
        assert "SortAggregate" not in plans[name + form] and "HashAggregate" in plans[name + form]


@pytest.mark.parametrize("name", [n for n in ALL if n.endswith("__limit")])
def test_first_rows_are_kept_in_heaps(plans, name):
    assert "TakeOrderedAndProject(limit=20" in plans[name]
    assert "rangepartitioning" not in plans[name]


@pytest.mark.parametrize("unit", ["day", "hour", "minute", "second"])
def test_published_audit_slots_unfold_no_job(plans, unit):
    text = plans[f"audit_slots_by_{unit}__literal"]
    assert "sequence" not in text[text.index("Window") :]


def test_approximate_counts_shuffle_sketches(plans):
    text = plans["concurrent_queries_by_minute__approximate"]
    above, below = text.split("partial_hll_sketch_agg")
    assert "Exchange hashpartitioning" in above and "hashpartitioning" not in below


def test_arrays_of_jobs_are_not_moved(plans):
    """Slots and jobs are shuffled once, as rows; arrays, their join and the order need no further exchange."""
    text = plans["queries_and_reservation_usage_per_second__literal"]
    assert text.count("Exchange") == 1 and text.count("partial_collect_list") == 4  # jobs and slots, twice
    assert "collect_list" not in text[text.index("Exchange rangepartitioning(start_time") :]


def test_job_lists_read_only_their_columns(laid_out):
    text = plan(registry.reports()["top_cost_users"](laid_out))
    (scan,) = re.findall(r"FileScan parquet \[(.*?)\]", text)
    assert "query#" not in scan and "labels#" not in scan and "referenced_tables#" not in scan


def test_audit_reads_only_the_leaves_it_uses(laid_out):
    df = registry.reports()["audit_slots_by_minute"](laid_out)
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "jobConfiguration:struct<dryRun:boolean>" in schema
    assert "referencedTables" not in schema and "labels" not in schema
    assert "GreaterThanOrEqual(timestamp" in text
