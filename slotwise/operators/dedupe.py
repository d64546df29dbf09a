"""Keeping one row per key.

A rank filtered to 1 lets Spark cut every key to one row inside each map task
before the shuffle (``WindowGroupLimit``), so a key that holds a large share of
all rows costs no more than one row per task. Orders end in content columns to
make ties repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a job's rows are ranked: the version that ended last, then by content.
JOB_ORDER = ("end_time", "creation_time", "start_time", "total_slot_ms", "total_bytes_billed")


# Narrow columns in which two versions of a job may still differ.
_JOB_TIES = (
    "project_id", "user_email", "state", "job_type", "statement_type", "reservation_id", "edition",
    "total_bytes_processed",
)


def tie_hash(df: DataFrame, narrow: Sequence[str], reads: Sequence[str] = ()) -> Column:
    """A hash that settles ties among rows equal in their order.

    It takes the narrow columns that are there and the wide ones that the report
    reads anyway, so that no other column is read for it.
    """
    names = [c for c in (*narrow, *reads) if c in df.columns]
    return F.xxhash64(F.lit(0), *names)


def descending(names: Sequence[str]) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def first_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]
) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest_jobs(jobs: DataFrame, reads: Sequence[str] = ()) -> DataFrame:
    """One row per job id: the version that ended last.

    Versions equal in the whole order are told apart by a hash, which takes in the
    wide columns (``reads``) that the report shows.
    """
    order = [*descending(JOB_ORDER), tie_hash(jobs, _JOB_TIES, reads).asc()]
    return first_per_key(jobs, ["job_id"], order)


def dearest_run_per_text(
    runs: DataFrame, query: str, nbytes: str, ties: Sequence[Column]
) -> DataFrame:
    """The run of each query text that billed most; the text is keyed by its hash."""
    return first_per_key(
        runs, [F.sha2(F.col(query), 256)], [F.col(nbytes).desc_nulls_last(), *ties]
    )


def dearest_job_per_text(jobs: DataFrame) -> DataFrame:
    """The same for rows of the job view; equal bytes go to the run that ended last."""
    ties = [
        F.col("end_time").desc_nulls_last(),
        F.col("job_id").asc(),
        *descending(["creation_time", "total_slot_ms"]),
        tie_hash(jobs, _JOB_TIES).asc(),
    ]
    return dearest_run_per_text(jobs, "query", "total_bytes_billed", ties)


def dearest_if_latest(jobs: DataFrame) -> DataFrame:
    """Each text's dearest row, kept only if it is also its job's latest row.

    Both ranks are taken over the same undeduplicated rows. They are computed
    apart, each with its own early cut, and met on the job id.
    """
    jobs = jobs.withColumn("_tie", tie_hash(jobs, _JOB_TIES))
    dearest = dearest_job_per_text(jobs)
    order = [*descending(JOB_ORDER), F.col("_tie").asc()]
    latest = first_per_key(jobs.select("job_id", *JOB_ORDER, "_tie"), ["job_id"], order)
    same = [dearest[c].eqNullSafe(latest[c]) for c in (*JOB_ORDER, "_tie")]
    on = [dearest["job_id"] == latest["job_id"], *same]
    return dearest.join(latest, on, "left_semi").drop("_tie")
