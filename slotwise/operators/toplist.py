"""Ordered reports cut to their first rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame

Report = Callable[..., DataFrame]


def with_limit(order: Callable[[], list[Column]] | None = None) -> Callable[[Report], Report]:
    """Give an ordered report an optional ``limit``: its first so many rows.

    Each task then keeps a heap of that many rows, and the whole result is not sorted
    by range (``TakeOrderedAndProject``). A report without an order of its own names
    the one by which rows are first.
    """

    def wrap(report: Report) -> Report:
        @wraps(report)
        def limited(*tables, limit: int | None = None, **arguments) -> DataFrame:
            rows = report(*tables, **arguments)
            if limit is None:
                return rows
            return (rows.orderBy(*order()) if order else rows).limit(limit)

        return limited

    return wrap
