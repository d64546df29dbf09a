"""Tables from files, from a catalog and from frames give the same reports."""

import pytest

from slotwise import Warehouse, schemas
from slotwise.plans import audit, jobs, slots
from slotwise.sources.layout import write_table

AS_OF = "2024-01-31 00:00:00"


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("table", sorted(schemas.ALL))
def test_laid_out_tables_keep_every_row(warehouse, laid_out, table):
    before, after = getattr(warehouse, table), getattr(laid_out, table)
    assert after.columns[: len(before.columns)] == before.columns
    assert before.count() == after.count()


def test_reports_agree_on_both(warehouse, laid_out):
    for report in (jobs.general_job_information, slots.slots_by_hour, audit.table_query_counts):
        assert same(report(warehouse, as_of=AS_OF), report(laid_out, as_of=AS_OF))


def test_catalog_tables(spark, warehouse):
    warehouse.jobs.createOrReplaceGlobalTempView("jobs")
    wh = Warehouse.from_catalog(spark, "global_temp")
    assert same(jobs.top_cost_users(wh, as_of=AS_OF), jobs.top_cost_users(warehouse, as_of=AS_OF))


def test_other_formats(spark, warehouse, tmp_path):
    write_table(warehouse.table_storage, str(tmp_path), "table_storage", "orc")
    wh = Warehouse.from_path(spark, str(tmp_path), "orc")
    assert same(wh.table_storage, warehouse.table_storage)


def test_one_day_is_replaced_alone(spark, warehouse, tmp_path):
    log = warehouse.table_storage_usage
    write_table(log, str(tmp_path), "table_storage_usage")
    wh = Warehouse.from_path(spark, str(tmp_path))
    days = wh.table_storage_usage.groupBy("usage_date").count()
    day = days.orderBy("usage_date").first().usage_date
    some = log.filter(log.usage_date == day).limit(1)
    write_table(some, str(tmp_path), "table_storage_usage", days_only=True)
    again = Warehouse.from_path(spark, str(tmp_path)).table_storage_usage
    assert again.filter(again.usage_date == day).count() == 1
    assert again.filter(again.usage_date != day).count() == log.filter(log.usage_date != day).count()
    with pytest.raises(ValueError):
        write_table(warehouse.tables, str(tmp_path), "tables", days_only=True)


def test_usage_is_in_month_folders(warehouse, laid_out):
    months = laid_out.table_storage_usage.select("usage_date_month").distinct().count()
    days = warehouse.table_storage_usage.select("usage_date").distinct().count()
    assert months <= 84 + 1 < days
    assert laid_out.table_storage_usage.filter("usage_date_month <> trunc(usage_date, 'month')").isEmpty()


def test_unknown_table(warehouse):
    with pytest.raises(AttributeError):
        warehouse.no_such_table


def test_session_is_pinned_to_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    Warehouse.from_frames(spark, {})
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
