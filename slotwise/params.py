"""Report parameters: the moment a report is taken at, and prices."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from slotwise import fixed_values as fv

AsOf = str | datetime


def utc_session(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC, which civil times and UTC dates here rely on."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def utc(as_of: AsOf) -> datetime:
    """``as_of`` as a naive UTC datetime (naive input is taken to be UTC)."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def instant(as_of: AsOf) -> Column:
    """A timestamp literal, independent of any session or machine time zone."""
    return F.expr(f"TIMESTAMP '{utc(as_of).isoformat(sep=' ')} UTC'")


def days_before(as_of: AsOf, days: float) -> datetime:
    return utc(as_of) - timedelta(days=days)


@dataclass(frozen=True)
class Prices:
    """List prices; every report takes one and reads only what it needs."""

    on_demand: float = fv.ON_DEMAND_PER_TIB
    on_demand_legacy: float = fv.ON_DEMAND_PER_TIB_LEGACY
    standard: float = fv.STANDARD_PAYG
    enterprise: float = fv.ENTERPRISE_PAYG
    enterprise_1y: float = fv.ENTERPRISE_1Y
    enterprise_3y: float = fv.ENTERPRISE_3Y
    enterprise_plus: float = fv.ENTERPRISE_PLUS_PAYG
    enterprise_plus_1y: float = fv.ENTERPRISE_PLUS_1Y
    enterprise_plus_3y: float = fv.ENTERPRISE_PLUS_3Y
    active_logical: float = fv.ACTIVE_LOGICAL
    long_term_logical: float = fv.LONG_TERM_LOGICAL
    active_physical: float = fv.ACTIVE_PHYSICAL_US
    long_term_physical: float = fv.LONG_TERM_PHYSICAL_US
    active_logical_hourly: float = fv.ACTIVE_LOGICAL_HOURLY
    long_term_logical_hourly: float = fv.LONG_TERM_LOGICAL_HOURLY
    active_physical_hourly: float = fv.ACTIVE_PHYSICAL_HOURLY
    long_term_physical_hourly: float = fv.LONG_TERM_PHYSICAL_HOURLY

    @classmethod
    def us(cls) -> Prices:
        return cls()

    @classmethod
    def eu(cls) -> Prices:
        return replace(
            cls(),
            active_physical=fv.ACTIVE_PHYSICAL_EU,
            long_term_physical=fv.LONG_TERM_PHYSICAL_EU,
        )


def per_slot_second(hourly: float) -> Decimal:
    """A slot-hour price per second, at the nine decimals the bill uses."""
    exact = Decimal(str(hourly)) / 3600
    return exact.quantize(Decimal("0.000000001"), rounding=ROUND_HALF_UP)
