"""Repeated query texts: how often each ran and what its runs add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.costs import sum_bytes


def runs_per_text(runs: DataFrame, query: str, nbytes: Column) -> DataFrame:
    """Per query text, its runs and their summed bytes; rows without text drop out.

    One hash aggregate with map-side combining stands in for matching every run
    with every other run of the same text. The text is a key and the buffers are of
    fixed size; a text in a buffer would turn it into a sort of whole texts.
    """
    return (
        runs.filter(F.col(query).isNotNull())
        .groupBy(F.col(query).alias("query"))
        .agg(F.count("*").alias("runs"), sum_bytes(nbytes).alias("bytes"))
    )


def attach_run_count(runs: DataFrame, query: str, name: str) -> DataFrame:
    """Every run with a text, with the number of runs of that text.

    One narrow pass counts the runs per hash of the text, summed map-side, and one
    wide pass joins each run with the count. A window would gather all runs of a
    text in one task; of a join, Spark splits the runs of a crowded text over several
    tasks while it runs, as each needs the one count only. It does so if both sides
    are dealt out for the join, so the counts are keyed by other bytes there than
    where they are summed.
    """
    keyed = runs.withColumn("_h", F.sha2(F.col(query), 256)).filter(F.col("_h").isNotNull())
    counts = keyed.groupBy("_h").agg(F.count("*").alias(name))
    counts = counts.select(F.unhex("_h").alias("_k"), name)
    return keyed.withColumn("_k", F.unhex("_h")).join(counts, "_k").drop("_h", "_k")
