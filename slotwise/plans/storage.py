"""Storage billing: logical against physical, last use and daily usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.functions.costs import in_unit, sum_bytes
from slotwise.functions.texts import money, readable_size, storage_advice, storage_ddl
from slotwise.functions.times import instant_text
from slotwise.operators.scans import between, of_project, within_civil
from slotwise.params import AsOf, Prices, days_before, instant, utc
from slotwise.sources.warehouse import Warehouse

_SIZES = (
    "total_rows",
    "total_partitions",
    "total_logical_bytes",
    "active_logical_bytes",
    "long_term_logical_bytes",
    "total_physical_bytes",
    "active_physical_bytes",
    "long_term_physical_bytes",
    "time_travel_physical_bytes",
    "fail_safe_physical_bytes",
)


def _same_table(storage: DataFrame, other: DataFrame, *, dataset: bool = True) -> Column:
    on = (storage["project_id"] == other["table_catalog"]) & (
        storage["table_name"] == other["table_name"]
    )
    return on & (storage["table_schema"] == other["table_schema"]) if dataset else on


def existing_storage(wh: Warehouse, *, literal: bool = False) -> DataFrame:
    """Storage of base tables that exist now.

    ``literal`` asks only that some dataset of the project has a table of the name.
    """
    storage = wh.table_storage.filter(~F.col("deleted"))
    base = wh.tables.filter(F.col("table_type") == "BASE TABLE")
    return storage.join(base, _same_table(storage, base, dataset=not literal), "left_semi")


def _model_prices(storage: DataFrame, keys: Sequence[str], prices: Prices) -> DataFrame:
    """Per key, the monthly price of its bytes under either billing model.

    Whole bytes are summed and priced once, so the price does not depend on the
    order of summation. Active physical bytes are counted without time travel.
    """
    active = F.col("active_physical_bytes") - F.col("time_travel_physical_bytes")
    sums = storage.groupBy(*keys).agg(
        sum_bytes(F.col("active_logical_bytes")).alias("al"),
        sum_bytes(F.col("long_term_logical_bytes")).alias("ll"),
        sum_bytes(active).alias("ap"),
        sum_bytes(F.col("long_term_physical_bytes")).alias("lp"),
        sum_bytes(F.col("time_travel_physical_bytes")).alias("tt"),
        sum_bytes(F.col("fail_safe_physical_bytes")).alias("fs"),
    )

    def price(column: str, per_gib: float) -> Column:
        return in_unit(F.col(column), fv.GIB) * F.lit(per_gib)

    return (
        sums.withColumns(
            {
                "active_logical": price("al", prices.active_logical),
                "long_term_logical": price("ll", prices.long_term_logical),
                "active_physical": price("ap", prices.active_physical),
                "long_term_physical": price("lp", prices.long_term_physical),
                "extra": price("tt", prices.active_physical) + price("fs", prices.active_physical),
            }
        )
        .withColumn("logical", F.col("active_logical") + F.col("long_term_logical"))
        .withColumn(
            "physical", (F.col("active_physical") + F.col("long_term_physical")) + F.col("extra")
        )
        .withColumn("difference", F.col("logical") - F.col("physical"))
    )


def project_per_table_storage_model_recommendations(
    wh: Warehouse, *, prices: Prices = Prices.us(), literal: bool = False
) -> DataFrame:
    """Per table, its price under both models and the cheaper one."""
    storage = existing_storage(wh, literal=literal)
    tables = storage.select(
        "table_name", F.col("table_schema").alias("dataset"), *_SIZES
    ).distinct()
    wins = F.coalesce(F.col("logical") < F.col("physical"), F.lit(False))
    return _model_prices(tables, ["table_name", "dataset"], prices).select(
        "dataset",
        "table_name",
        money(F.col("active_logical")).alias("logical_active_price"),
        money(F.col("active_physical")).alias("base_physical_price"),
        money(F.col("long_term_logical")).alias("logical_long_term_price"),
        money(F.col("long_term_physical")).alias("base_long_term_price"),
        money(F.col("extra")).alias("additional_costs_for_physical_storage"),
        money(F.col("logical")).alias("logical_storage_price"),
        money(F.col("physical")).alias("physical_storage_price"),
        money(F.col("difference")).alias("difference_in_price_if_physical_is_chosen"),
        F.when(wins, "Logical storage").otherwise("Physical storage").alias("recommendation"),
    )


def project_storage_model_recommendation(
    wh: Warehouse,
    *,
    prices: Prices = Prices.us(),
    location: str = "region-us",
    literal: bool = False,
) -> DataFrame:
    """Per dataset, its price under both models, the advice and the statement for it."""
    storage = existing_storage(wh, literal=literal)
    tables = storage.select(
        "table_schema",
        "table_name",
        F.concat("project_id", F.lit("."), "table_schema").alias("dataset"),
        *_SIZES,
    ).distinct()
    models = wh.schemata_options.filter(F.col("option_name") == "storage_billing_model").select(
        F.col("schema_name").alias("table_schema"), F.col("option_value").alias("model")
    )
    # Summed before the options are looked up: one row per dataset meets them.
    priced = _model_prices(tables, ["dataset", "table_schema"], prices)
    known = priced.join(models, "table_schema", "left").withColumn(
        "model", F.coalesce("model", F.lit("LOGICAL"))
    )
    compared = (F.col("model"), F.col("logical"), F.col("physical"))
    return known.select(
        "dataset",
        money(F.col("active_logical")).alias("logical_active_price"),
        money(F.col("long_term_logical")).alias("logical_long_term_price"),
        money(F.col("active_physical")).alias("physical_active_price"),
        money(F.col("long_term_physical")).alias("physical_long_term_price"),
        money(F.col("extra")).alias("additional_costs_for_physical_storage"),
        money(F.col("logical")).alias("logical_storage_price"),
        money(F.col("physical")).alias("physical_storage_price"),
        money(F.col("difference")).alias("savings_in_price_if_physical_is_chosen"),
        F.col("model").alias("current_storage_model"),
        storage_advice(*compared).alias("recommendation"),
        storage_ddl(F.col("dataset"), *compared, location).alias("recommendation_change_SQL"),
    )


def table_storage_by_most_recently_queried(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Every table with its last query, size and price; unqueried tables come first."""
    jobs = within_civil(of_project(wh.jobs, project_id), "creation_time", as_of, days, tz).filter(
        (F.col("job_type") == "QUERY") & (F.col("state") == "DONE")
    )
    last_used = (
        jobs.select(
            "creation_time",
            F.inline("referenced_tables").alias("project_id", "dataset_id", "table_id"),
        )
        .groupBy("project_id", "dataset_id", "table_id")
        .agg(F.max("creation_time").alias("last"))
    )
    storage, tables = wh.table_storage, wh.tables
    kept = storage.join(tables, _same_table(storage, tables), "left_semi")
    options = wh.table_options.filter(F.col("option_name") == "storage_billing_model").select(
        F.col("table_catalog").alias("project_id"),
        "table_schema",
        "table_name",
        F.col("option_value").alias("model"),
    )
    known = kept.join(options, ["project_id", "table_schema", "table_name"], "left")
    physical = F.coalesce(F.col("model") == "PHYSICAL", F.lit(False))

    def billed(size: str) -> Column:
        return F.when(physical, F.col(f"{size}_physical_bytes")).otherwise(
            F.col(f"{size}_logical_bytes")
        )

    sized = known.select(
        "project_id",
        F.col("table_schema").alias("dataset_id"),
        F.col("table_name").alias("table_id"),
        F.coalesce("model", F.lit("LOGICAL")).alias("storage_billing_model"),
        billed("total").alias("total_billed_bytes"),
        billed("active").alias("active_billed_bytes"),
        billed("long_term").alias("long_term_billed_bytes"),
    )
    logical = F.col("storage_billing_model") == "LOGICAL"

    def price(size: str, on_logical: float, on_physical: float) -> Column:
        rate = F.when(logical, F.lit(on_logical)).otherwise(F.lit(on_physical))
        return in_unit(F.col(f"{size}_billed_bytes"), fv.GIB) * rate

    never = F.concat(F.lit("Prior to "), instant_text(instant(days_before(as_of, days))))
    cost = price("active", prices.active_logical, prices.active_physical) + price(
        "long_term", prices.long_term_logical, prices.long_term_physical
    )
    return (
        sized.join(last_used, ["project_id", "dataset_id", "table_id"], "left")
        .orderBy(
            F.col("last").asc_nulls_first(),
            F.col("total_billed_bytes").desc(),
            "project_id",
            "dataset_id",
            "table_id",
        )
        .select(
            "project_id",
            "dataset_id",
            "table_id",
            F.coalesce(instant_text(F.col("last")), never).alias("last_queried_time"),
            "storage_billing_model",
            money(cost).alias("table_storage_price"),
            readable_size(F.col("total_billed_bytes")).alias("readable_total_billed_size"),
            "total_billed_bytes",
            readable_size(F.col("active_billed_bytes")).alias("readable_active_size"),
            "active_billed_bytes",
            readable_size(F.col("long_term_billed_bytes")).alias("readable_long_term_size"),
        )
    )


def table_usage_and_costs_per_day(
    wh: Warehouse, *, as_of: AsOf, days: int = 7, prices: Prices = Prices.us()
) -> DataFrame:
    """Per day and table, billed usage in GiB and TiB and its cost, by kind."""
    hourly = {
        "active_logical": prices.active_logical_hourly,
        "long_term_logical": prices.long_term_logical_hourly,
        "active_physical": prices.active_physical_hourly,
        "long_term_physical": prices.long_term_physical_hourly,
    }
    kinds = [
        f"{span}_{model}"
        for model in ("logical", "physical")
        for span in ("total", "active", "long_term")
    ]
    keys = ["usage_date", "project_id", "table_schema", "table_name"]
    since = F.lit(days_before(utc(as_of), days).date())
    sums = (
        between(wh.table_storage_usage, "usage_date", since)
        .groupBy(*keys)
        .agg(*[sum_bytes(F.col(f"billable_{k}_usage")).alias(k) for k in kinds])
    )

    def shown(kind: str) -> list[Column]:
        gib = in_unit(F.col(kind), fv.GIB)
        columns = [
            gib.alias(f"billable_{kind}_usage_in_gibytes"),
            in_unit(F.col(kind), fv.TIB).alias(f"billable_{kind}_usage_in_tibytes"),
        ]
        if kind in hourly:
            cost = gib * F.lit(hourly[kind])
            columns += [cost.alias(f"{kind}_cost"), money(cost).alias(f"{kind}_pretty_cost")]
        return columns

    return sums.select(*keys, *[c for k in kinds for c in shown(k)]).orderBy(*keys)
