"""On-demand against editions: per run and for the whole look-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.functions.costs import (
    at_least,
    billed_hours,
    byte_ladder,
    dbl,
    in_unit,
    on_demand,
    or_zero,
    slot_rate,
    step_up,
)
from slotwise.functions.times import elapsed_ms, truncate
from slotwise.operators.repeats import attach_run_count
from slotwise.operators.scans import of_project, within_civil
from slotwise.params import AsOf, Prices
from slotwise.plans.jobs import finished_jobs
from slotwise.sources.warehouse import Warehouse


def _measured_runs(
    wh: Warehouse, as_of: AsOf, days: int, tz: str, project_id: str | None
) -> DataFrame:
    """Finished jobs of any type with their slots and billed hours."""
    start, end = F.col("start_time"), F.col("end_time")
    return finished_jobs(wh, as_of, days, tz=tz, project_id=project_id).select(
        F.col("project_id").alias("projectId"),
        "query",
        start.alias("startTime"),
        end.alias("endTime"),
        "job_id",
        F.round(slot_rate(F.col("total_slot_ms"), start, end), 2).alias("approximateSlotCount"),
        billed_hours(elapsed_ms(start, end)).alias("hours"),
        or_zero(F.col("total_bytes_billed")).alias("bytes"),
    )


def billing_recommendation_per_query(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 14,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """For each run, whether each edition would have cost less than on-demand.

    Edition costs are slot-hours times the rate. ``literal`` leaves the slots out
    and judges two of the Plus plans by the plain Enterprise costs.
    """
    # Cost column, recommendation column, name of the plan, hourly price.
    plus_1y = fv.PLAN_ENTERPRISE_1Y if literal else fv.PLAN_ENTERPRISE_PLUS_1Y
    plans = [
        ("standardEditionCost", "standardEditionRecommendation",
         fv.PLAN_STANDARD, prices.standard),
        ("enterpriseEditionCost", "enterpriseEditionRecommendation",
         fv.PLAN_ENTERPRISE, prices.enterprise),
        ("enterpriseEdition1YearCost", "enterpriseEdition1YearRecommendation",
         fv.PLAN_ENTERPRISE_1Y, prices.enterprise_1y),
        ("enterpriseEdition3YearCost", "enterpriseEdition3YearRecommendation",
         fv.PLAN_ENTERPRISE_3Y, prices.enterprise_3y),
        ("enterprisePlusEditionCost", "enterprisePlusEditionRecommendation",
         fv.PLAN_ENTERPRISE_PLUS, prices.enterprise_plus),
        ("enterprisePlusEdition1YearCost", "enterpriseEditionPlus1YearRecommendation",
         plus_1y, prices.enterprise_plus_1y),
        ("enterprisePlusEdition3YearCost", "enterprisePlusEdition3YearRecommendation",
         fv.PLAN_ENTERPRISE_PLUS_3Y, prices.enterprise_plus_3y),
    ]
    judged_by = {}
    if literal:
        judged_by = {
            "enterprisePlusEditionCost": "enterpriseEditionCost",
            "enterprisePlusEdition1YearCost": "enterpriseEdition1YearCost",
        }

    slots = step_up(F.col("approximateSlotCount"))
    used = F.col("hours") if literal else F.col("hours") * F.col("billedSlotCount")
    runs = (
        _measured_runs(wh, as_of, days, tz, project_id)
        .filter(F.col("query").isNotNull())
        .withColumns(
            {
                "billedSlotCount": slots,
                "legacyOnDemandCost": on_demand(F.col("bytes"), prices.on_demand_legacy),
                "onDemandCost": on_demand(F.col("bytes"), prices.on_demand),
            }
        )
        .withColumns({cost: used * F.lit(rate) for cost, _, _, rate in plans})
    )

    def advice(cost: str, name: str) -> Column:
        dearer = F.col("onDemandCost") - F.col(judged_by.get(cost, cost)) < 0
        return F.when(dearer, "On-demand").otherwise(name)

    return (
        runs.orderBy(
            F.col("onDemandCost").desc(), F.col("approximateSlotCount").desc(), "job_id", "startTime"
        )
        .select(
            F.col("projectId").alias("projectid"),
            "query",
            *[advice(cost, name).alias(column) for cost, column, name, _ in plans],
            "startTime",
            "endTime",
            F.col("hours").alias("editionsBilledDurationInHours"),
            "approximateSlotCount",
            "billedSlotCount",
            "legacyOnDemandCost",
            "onDemandCost",
            *[cost for cost, _, _, _ in plans],
            *byte_ladder(F.col("bytes")),
        )
    )


def costs_by_query(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Slot-hours and on-demand cost of each run, with the runs of its text.

    Every run bills at least 10 MiB. ``literal`` puts that floor on the rounded
    amount in each unit, instead of on the bytes.
    """
    floor = fv.MIN_BILLED_BYTES
    runs = attach_run_count(_measured_runs(wh, as_of, days, tz, project_id), "query", "executionCount")
    billed = at_least(F.col("bytes"), floor)
    names = ("billedBytes", "billedMegabytes", "billedGigabytes", "billedTerabytes")
    if literal:
        amounts = [
            at_least(amount, floor / unit).alias(name)
            for name, unit, amount in zip(
                names, (1, fv.MIB, fv.GIB, fv.TIB), byte_ladder(F.col("bytes"))
            )
        ]
    else:
        amounts = byte_ladder(billed, names)
    slots = F.ceil(F.col("approximateSlotCount") / F.lit(float(fv.AUTOSCALE_STEP)))
    return (
        runs.withColumns(
            {
                "billedSlotCount": dbl(slots) * F.lit(float(fv.AUTOSCALE_STEP)),
                "onDemandCost": on_demand(billed, prices.on_demand),
            }
        )
        .withColumn("slotHours", F.col("billedSlotCount") * F.col("hours"))
        .orderBy(F.col("onDemandCost").desc(), F.col("slotHours").desc(), "job_id", "startTime")
        .select(
            "projectId",
            "query",
            "startTime",
            "endTime",
            F.col("hours").alias("queryDurationHours"),
            "approximateSlotCount",
            "billedSlotCount",
            "slotHours",
            "onDemandCost",
            "executionCount",
            *amounts,
        )
    )


def total_billing_recommendation(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 30,
    baselines: Sequence[int] = fv.BASELINES,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = fv.DEFAULT_TZ,
) -> DataFrame:
    """Cost of the look-back on demand and with each slot baseline and plan.

    Demand per minute is rounded up to the autoscaler's step; what exceeds the
    baseline is autoscaled. All baselines are summed in one pass over the minutes.
    ``literal`` takes each second of the timeline for a minute.
    """
    timeline = within_civil(
        of_project(wh.jobs_timeline, project_id), "period_start", as_of, days, tz
    )
    period = F.col("period_start") if literal else truncate(F.col("period_start"), "minute")
    minutes = (
        timeline.filter(F.col("job_type") == "QUERY")
        .groupBy(period.alias("minute"))
        .agg((F.sum("period_slot_ms") / F.lit(60_000.0)).alias("slots"))
        .select(step_up(F.col("slots")).cast("bigint").alias("provisioned"))
    )
    over = [
        F.sum(F.greatest(F.col("provisioned") - b, F.lit(0))).alias(f"over_{b}") for b in baselines
    ]
    demand = minutes.filter(F.col("provisioned").isNotNull()).agg(*over)

    billed = F.when(
        F.col("total_bytes_billed").isNotNull(),
        F.greatest(F.col("total_bytes_billed"), F.lit(fv.MIN_BILLED_BYTES)),
    ).cast("decimal(20,0)")
    totals = within_civil(of_project(wh.jobs, project_id), "creation_time", as_of, days, tz).agg(
        F.count("*").alias("runs"),
        F.count_distinct(F.sha2(F.col("query"), 256)).alias("texts"),
        F.sum(billed).alias("bytes"),
    )

    # One row each; stacked and folded into one, so no join is needed.
    stacked = demand.unionByName(totals, allowMissingColumns=True)
    both = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    scenario = F.inline(
        F.array(
            *[
                F.struct(F.lit(b).cast("bigint").alias("baseline"), F.col(f"over_{b}").alias("over"))
                for b in baselines
            ]
        )
    )
    rows = both.select("runs", "texts", "bytes", scenario)

    calendar_minutes = days * 24 * 60
    tib = in_unit(F.col("bytes"), fv.TIB)

    def plan_cost(committed: float, payg: float) -> Column:
        held = dbl(F.col("baseline") * calendar_minutes) / F.lit(60.0) * F.lit(committed)
        scaled = dbl(F.col("over")) / F.lit(60.0) * F.lit(payg)
        return F.round(held + scaled, 2)

    p = prices
    costed = rows.select(
        F.lit(f"Last {days} days").alias("time_period"),
        F.col("texts").alias("total_unique_queries"),
        F.col("runs").alias("total_query_executions"),
        F.round(tib, 2).alias("total_terabytes_billed"),
        F.round(tib * F.lit(p.on_demand), 2).alias("total_on_demand_cost"),
        F.col("baseline").alias("baseline_slots"),
        plan_cost(p.standard, p.standard).alias("standard_total_cost"),
        plan_cost(p.enterprise, p.enterprise).alias("enterprise_payg_cost"),
        plan_cost(p.enterprise_1y, p.enterprise).alias("enterprise_1yr_cost"),
        plan_cost(p.enterprise_3y, p.enterprise).alias("enterprise_3yr_cost"),
        plan_cost(p.enterprise_plus, p.enterprise_plus).alias("enterprise_plus_payg_cost"),
        plan_cost(p.enterprise_plus_1y, p.enterprise_plus).alias("enterprise_plus_1yr_cost"),
        plan_cost(p.enterprise_plus_3y, p.enterprise_plus).alias("enterprise_plus_3yr_cost"),
    )
    saved = F.col("total_on_demand_cost") - F.col("enterprise_3yr_cost")
    return costed.withColumns(
        {
            "savings_vs_ondemand_at_3yr": F.round(saved, 2),
            "savings_pct_at_3yr": F.round(
                F.try_divide(F.lit(100.0) * saved, F.col("total_on_demand_cost")), 2
            ),
        }
    ).orderBy("baseline_slots")
