"""What reservations held, what used them and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.fixed_values import DEFAULT_TZ
from slotwise.functions.costs import dbl, edition_slot_second, payg_rate, sum_whole
from slotwise.functions.texts import money
from slotwise.functions.times import truncate
from slotwise.operators.collecting import by_order, collected
from slotwise.operators.scans import created_within_absolute, of_project, within_absolute, within_civil
from slotwise.params import AsOf, Prices
from slotwise.sources.warehouse import Warehouse

def _seconds(wh: Warehouse, as_of: AsOf, days: int) -> DataFrame:
    """The per-second details of each reservation's minutes."""
    minutes = within_absolute(wh.reservations_timeline, "period_start", as_of, days=days)
    return minutes.select("reservation_name", "edition", F.explode("per_second_details").alias("d"))


def autoscale_usage_and_costs_per_second(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    literal: bool = False,
) -> DataFrame:
    """Slots autoscaled and assigned in each second, and their cost.

    ``literal`` shows the assigned slots under the name of their cost, and knows
    the Plus edition only by its spelling with a space.
    """
    rate = edition_slot_second(F.col("edition"), prices, literal=literal)
    current, most = F.col("d.autoscale_current_slots"), F.col("d.autoscale_max_slots")
    assigned = F.col("d.slots_assigned")
    total = F.col("autoscaled_cost") + F.col("_assigned_cost")
    shown = (
        [F.col("slots_assigned").alias("slots_assigned_cost")]
        if literal
        else ["slots_assigned", F.col("_assigned_cost").alias("slots_assigned_cost")]
    )
    return (
        _seconds(wh, as_of, days)
        .select(
            F.col("d.start_time").alias("start_time"),
            "reservation_name",
            current.alias("autoscale_current_slots"),
            most.alias("autoscale_max_slots"),
            F.try_divide(current, most).alias("autoscale_usage_ratio"),
            (rate * current).alias("autoscaled_cost"),
            assigned.alias("slots_assigned"),
            (rate * assigned).alias("_assigned_cost"),
            F.col("d.slots_max_assigned").alias("slots_max_assigned"),
        )
        .select(
            "start_time",
            "reservation_name",
            "autoscale_current_slots",
            "autoscale_max_slots",
            "autoscale_usage_ratio",
            "autoscaled_cost",
            *shown,
            "slots_max_assigned",
            total.alias("total_slots_cost"),
            money(total).alias("total_slots_cost_formatted"),
        )
        .orderBy(F.col("start_time").desc(), "reservation_name")
    )


def bqe_slot_utilization_by_minute(
    wh: Warehouse,
    *,
    as_of: AsOf,
    reservation_name: str,
    days: int = 7,
    literal: bool = False,
    project_id: str | None = None,
) -> DataFrame:
    """Per minute of one reservation, its slots, the jobs in it and the share used.

    A minute with autoscaled slots but no jobs is 0 % used; ``literal`` leaves it NULL.
    """
    minutes = (
        within_absolute(
            wh.reservations_timeline, "period_start", as_of, days=days, upper=False, strict=True
        )
        .filter(F.col("reservation_name") == reservation_name)
        .select(
            "period_start",
            "reservation_name",
            "slots_assigned",
            F.col("autoscale.current_slots").alias("current_slots"),
            F.col("autoscale.max_slots").alias("max_slots"),
            "reservation_id",
        )
    )
    script = F.col("statement_type") == "SCRIPT"
    timeline = created_within_absolute(
        of_project(wh.jobs_timeline, project_id), as_of, days=days, upper=False, strict=True
    )
    seconds = (
        timeline.filter(F.col("period_slot_ms").isNotNull() & ~F.coalesce(script, F.lit(False)))
        # A reservation's id ends in its name, so no list of ids is needed.
        .filter(F.element_at(F.split("reservation_id", "[.]"), -1) == reservation_name)
        .select(
            truncate(F.col("period_start"), "minute").alias("period_start"),
            "reservation_id",
            "job_id",
            "period_slot_ms",
        )
    )
    per_job = seconds.groupBy("period_start", "reservation_id", "job_id").agg(
        F.sum("period_slot_ms").alias("slot_ms")
    )
    per_minute = per_job.groupBy("period_start", "reservation_id").agg(
        F.count("job_id").alias("jobs"),
        F.round(dbl(sum_whole(F.col("slot_ms"))) / F.lit(60_000.0), 2).alias("slots"),
    )
    used = F.col("slots") if literal else F.coalesce(F.col("slots"), F.lit(0.0))
    share = F.when(F.col("current_slots") == 0, F.lit(0.0)).otherwise(
        F.try_divide(used, dbl(F.col("current_slots"))) * 100
    )
    return (
        minutes.join(per_minute, ["period_start", "reservation_id"], "left")
        .select(
            "period_start",
            "reservation_name",
            "slots_assigned",
            "current_slots",
            "max_slots",
            "reservation_id",
            F.coalesce("jobs", F.lit(0)).alias("active_jobs_per_period"),
            F.coalesce("slots", F.lit(0.0)).alias("slots_per_period"),
            share.alias("utilization_pct"),
        )
        .orderBy(F.col("period_start").desc())
    )


def jobs_per_second(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """One row per second, reservation and query job, with the job as a struct."""
    rate = dbl(edition_slot_second(F.col("edition"), prices, literal=literal))
    seconds_used = dbl(F.col("period_slot_ms")) / F.lit(1000.0)
    timeline = of_project(within_absolute(wh.jobs_timeline, "period_start", as_of, days=days), project_id)
    timeline = within_civil(timeline, "job_creation_time", as_of, days, tz)
    script = F.col("statement_type") == "SCRIPT"
    return timeline.filter(
        (F.col("job_type") == "QUERY")
        & ~F.coalesce(script, F.lit(False))
        & F.col("reservation_id").isNotNull()
    ).select(
        F.col("period_start").alias("start_time"),
        F.element_at(F.split("reservation_id", "[.]"), -1).alias("reservation_name"),
        F.struct(
            "period_slot_ms",
            seconds_used.alias("period_slot_s"),
            (rate * seconds_used).alias("editions_cost"),
            "project_id",
            "user_email",
            "job_id",
            "statement_type",
            "job_start_time",
            "state",
            F.col("total_bytes_billed").alias("total_bytes_billed_for_full_job"),
        ).alias("job"),
    )


def queries_and_reservation_usage_per_second(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    literal: bool = False,
    project_id: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Per second and reservation, its slots and each query job that used them.

    One row per second, reservation and job, whatever their number. ``literal`` gives
    one row per second and reservation with the whole array of its jobs, as first
    published; the array, in order of its structs, is bounded only by the jobs alive in
    one second of one reservation. Slots and jobs are dealt out by time together, as flat
    rows and once; arrays are made, met with their slots and sorted where they lie, so that
    none is moved. It also prices editions as in the autoscale report.
    """
    second = ["start_time", "reservation_name"]
    jobs = jobs_per_second(
        wh, as_of=as_of, days=days, prices=prices, literal=literal, project_id=project_id, tz=tz
    )
    slots = _seconds(wh, as_of, days).select(
        F.col("d.start_time").alias("start_time"),
        "reservation_name",
        "edition",
        *[
            F.col(f"d.{c}").alias(c)
            for c in (
                "autoscale_current_slots",
                "autoscale_max_slots",
                "slots_assigned",
                "slots_max_assigned",
            )
        ],
    )
    newest = F.col("start_time").desc()
    if literal:
        held = slots.select(*second, F.struct(*[c for c in slots.columns if c not in second]).alias("slot"))
        rows = held.unionByName(jobs, allowMissingColumns=True).dropna(subset=second)
        rows = by_order(rows, newest, F.col("reservation_name"))
        listed = collected(rows, second, "job", F.col("job.job_id"), name="jobs", parts=1, also={"slots": "slot"})
        met = listed.filter(F.size("jobs") > 0).select(*second, F.explode("slots").alias("slot"), "jobs")
        return met.orderBy(newest, "reservation_name").select(*second, "slot.*", "jobs")
    return slots.join(jobs, second).select(*slots.columns, "job.*").orderBy(newest, "reservation_name", "job_id")


def blended_rates(wh: Warehouse, prices: Prices, *, literal: bool = False) -> DataFrame:
    """Per edition with active commitments, the mean hourly price of its slots.

    Slots of a plan without a price of its own count at the pay-as-you-go rate;
    ``literal`` counts them as free.
    """
    priced = {
        ("ENTERPRISE", "ANNUAL"): prices.enterprise_1y,
        ("ENTERPRISE", "THREE_YEAR"): prices.enterprise_3y,
        ("ENTERPRISE_PLUS", "ANNUAL"): prices.enterprise_plus_1y,
        ("ENTERPRISE_PLUS", "THREE_YEAR"): prices.enterprise_plus_3y,
    }
    per_plan = (
        wh.capacity_commitments.filter(F.col("state") == "ACTIVE")
        .groupBy("edition")
        .agg(
            F.sum("slot_count").alias("slots"),
            *[
                F.sum(F.when(F.col("commitment_plan") == plan, F.col("slot_count"))).alias(plan)
                for plan in ("ANNUAL", "THREE_YEAR")
            ],
        )
    )

    def plan_rate(plan: str):
        chain = F
        for (edition, name), rate in priced.items():
            if name == plan:
                chain = chain.when(F.col("edition") == edition, F.lit(rate))
        rest = F.lit(0.0) if literal else payg_rate(F.col("edition"), prices)
        return chain.otherwise(rest)

    yearly, three = (F.coalesce(F.col(c), F.lit(0)) for c in ("ANNUAL", "THREE_YEAR"))
    other = F.col("slots") - yearly - three
    other_rate = F.lit(0.0) if literal else payg_rate(F.col("edition"), prices)
    hourly = yearly * plan_rate("ANNUAL") + three * plan_rate("THREE_YEAR") + other * other_rate
    return per_plan.select("edition", F.try_divide(hourly, F.col("slots")).alias("blended"))


def reservation_cost_per_day(
    wh: Warehouse,
    *,
    as_of: AsOf,
    days: int = 7,
    prices: Prices = Prices.us(),
    literal: bool = False,
) -> DataFrame:
    """Slot-hours and cost of each reservation per UTC day, with commitments."""
    usage = (
        within_absolute(wh.reservations_timeline, "period_start", as_of, days=days, upper=False)
        .groupBy(F.to_date("period_start").alias("usage_date"), "reservation_name")
        .agg(
            (dbl(F.sum("slot_capacity")) / F.lit(60.0)).alias("held"),
            (dbl(F.sum("period_autoscale_slot_seconds")) / F.lit(3600.0)).alias("scaled"),
        )
    )
    known = F.col("edition").isin("STANDARD", "ENTERPRISE", "ENTERPRISE_PLUS")
    payg = F.when(known, payg_rate(F.col("edition"), prices))
    held = F.col("held") * F.when(known, F.coalesce(F.col("blended"), payg))
    scaled = F.col("scaled") * payg
    return (
        usage.join(wh.reservations, "reservation_name")
        .join(blended_rates(wh, prices, literal=literal), "edition", "left")
        .select(
            "usage_date",
            "reservation_name",
            "edition",
            F.round("held", 2).alias("total_baseline_slot_hours"),
            F.round("scaled", 2).alias("total_autoscale_slot_hours"),
            F.round(held, 2).alias("daily_baseline_cost"),
            F.round(scaled, 2).alias("daily_autoscale_cost"),
            F.round(held + scaled, 2).alias("total_daily_reservation_cost"),
        )
        .orderBy(
            F.col("usage_date").desc(),
            F.col("total_daily_reservation_cost").desc(),
            "reservation_name",
        )
    )
