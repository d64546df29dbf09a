"""Arrays of all rows of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 32


def collected(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    spread: Column,
    *,
    name: str,
    parts: int = PARTS,
    also: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per key one array of the items of its rows, sorted; ``also`` names arrays of further columns.

    The rows of a key are first gathered in ``parts`` arrays, dealt by a hash of
    ``spread``, each in a task of its own; the task that makes the whole array reads
    that many rows of a key, not all of them, and sorts once. Rows that already lie by
    their keys (``by_order``) stay where they are; one part will do for them. A null item
    is left out.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(parts)).alias("_part")
    items = {name: item, **(also or {})}
    partial = df.groupBy(*keys, part).agg(*[F.collect_list(c).alias(f"_{n}") for n, c in items.items()])
    return partial.groupBy(*keys).agg(
        *[F.sort_array(F.flatten(F.collect_list(f"_{n}"))).alias(n) for n in items]
    )


def by_order(df: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt out by ranges of ``order``, in as many tasks as a shuffle has at most.

    They can be grouped by columns among which are those of ``order``, and sorted by an
    order that begins with it, without being moved again. Tasks are not made fewer, as
    Spark does for small shuffles: rows that resemble their neighbours take little space there.
    """
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
