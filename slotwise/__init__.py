"""Warehouse workload analytics: slots, concurrency, cost and storage reports on Spark."""

from slotwise.params import Prices, utc_session
from slotwise.sources.warehouse import Warehouse

__all__ = ["Prices", "Warehouse", "utc_session"]
