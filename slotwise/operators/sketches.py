"""Distinct counts by mergeable sketches of a fixed size.

An exact distinct count shuffles a row for each job and bucket; a sketch is at most
``2 ** LOG_SIZE`` bytes for each bucket and task, however many jobs the bucket has. The
relative standard error is 1.04 / sqrt(2 ** LOG_SIZE), 1.6 %; up to a few hundred
values a sketch keeps them apart and its estimate is the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 12


def distinct_sketch(value: str) -> Column:
    return F.hll_sketch_agg(value, LOG_SIZE)


def merged_sketch(sketch: str) -> Column:
    return F.hll_union_agg(sketch)


def estimated_distinct(sketches: DataFrame, sketch: str, name: str) -> DataFrame:
    """The estimate in place of the sketch."""
    others = [c for c in sketches.columns if c != sketch]
    return sketches.select(*others, F.hll_sketch_estimate(sketch).alias(name))
