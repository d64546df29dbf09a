"""Units, slots and prices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.functions.times import elapsed_ms
from slotwise.params import Prices, per_slot_second


def dbl(value: Column) -> Column:
    return value.cast("double")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def in_unit(nbytes: Column, unit: int) -> Column:
    return dbl(nbytes) / F.lit(float(unit))


def sum_bytes(nbytes: Column) -> Column:
    """Sum of byte counts that cannot overflow: 64 bits end at 8 EiB."""
    return F.sum(nbytes.cast("decimal(20,0)"))


def sum_whole(value: Column) -> Column:
    """Sum of whole numbers, such as billionths of a slot, that may pass 64 bits."""
    return F.sum(value.cast("decimal(38,0)"))


LADDER = ("totalBytesBilled", "totalMegabytesBilled", "totalGigabytesBilled", "totalTerabytesBilled")
LADDER_BINARY = ("totalBytesBilled", "totalMebibytesBilled", "totalGigibytesBilled", "totalTebibytesBilled")


def byte_ladder(nbytes: Column, names: tuple[str, ...] = LADDER) -> list[Column]:
    """Billed bytes as bytes, MiB, GiB and TiB at two decimals; NULL counts as 0."""
    known = or_zero(nbytes)
    units = (1, fv.MIB, fv.GIB, fv.TIB)
    return [F.round(in_unit(known, u), 2).alias(n) for u, n in zip(units, names)]


def on_demand(nbytes: Column, price: float, per: int = fv.TIB) -> Column:
    return in_unit(nbytes, per) * F.lit(price)


def slot_rate(slot_ms: Column, start: Column, end: Column, *, inverted: bool = False) -> Column:
    """Average slots held: slot time over run time (``inverted`` swaps the two)."""
    ran = elapsed_ms(start, end)
    return F.try_divide(ran, slot_ms) if inverted else F.try_divide(slot_ms, ran)


def nano_ratio(above: Column, below: Column) -> Column:
    """``above / below`` in whole billionths, NULL for a zero divisor.

    Long arithmetic only. Sums of these are exact whatever the order, which sums
    of doubles are not, so results do not change with the partitioning.
    """
    nano = 1_000_000_000
    return F.call_function("div", above, F.nullif(below, F.lit(0))) * nano + F.call_function(
        "div", (above % F.nullif(below, F.lit(0))) * nano, F.nullif(below, F.lit(0))
    )


def from_nano(total: Column) -> Column:
    return dbl(total) / F.lit(1e9)


def step_up(slots: Column, step: int = fv.AUTOSCALE_STEP) -> Column:
    """Slots rounded up to the autoscaler's step."""
    return dbl(F.ceil(slots / F.lit(float(step)))) * F.lit(float(step))


def billed_ms(ran_ms: Column, floor: int = fv.MIN_BILLED_MS) -> Column:
    """Run time with the one-minute minimum; an unknown run time stays unknown."""
    return F.when(ran_ms < floor, F.lit(floor).cast("bigint")).otherwise(ran_ms)


def billed_hours(ran_ms: Column) -> Column:
    return dbl(billed_ms(ran_ms)) / F.lit(3_600_000.0)


def at_least(value: Column, floor: float) -> Column:
    """The greater of the two, NULL when ``value`` is (``greatest`` would skip it)."""
    return F.when(value < floor, F.lit(floor)).otherwise(value)


def edition_key(edition: Column, literal: bool) -> Column:
    """Edition in its spaced spelling; ``literal`` matches only that spelling."""
    return edition if literal else F.replace(edition, F.lit("_"), F.lit(" "))


def edition_slot_second(edition: Column, prices: Prices, *, literal: bool = False) -> Column:
    """Price of one slot for one second, a decimal; NULL for an unknown edition."""
    key = edition_key(edition, literal)
    return (
        F.when(key == "STANDARD", F.lit(per_slot_second(prices.standard)))
        .when(key == "ENTERPRISE", F.lit(per_slot_second(prices.enterprise)))
        .when(key == "ENTERPRISE PLUS", F.lit(per_slot_second(prices.enterprise_plus)))
    )


def payg_rate(edition: Column, prices: Prices) -> Column:
    return (
        F.when(edition == "ENTERPRISE", F.lit(prices.enterprise))
        .when(edition == "ENTERPRISE_PLUS", F.lit(prices.enterprise_plus))
        .otherwise(F.lit(prices.standard))
    )
