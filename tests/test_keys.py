"""One row per key, repeated texts and checked joins, hot keys included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotwise.operators import repeats
from slotwise.operators.dedupe import (
    JOB_ORDER,
    dearest_if_latest,
    dearest_run_per_text,
    descending,
    latest_jobs,
)
from tests.helpers import frame, utc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jobs(spark, seed, count):
    """Runs of few texts; a third of all rows are versions of one job."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        hot = i % 3 == 0
        rows.append(
            {
                "job_id": "hot" if hot else f"j{rng.randint(0, count // 3)}",
                "query": rng.choice([None, "q1", "q2", f"q{i}"]),
                "end_time": rng.choice([None, utc(f"2024-01-01 00:{rng.randint(0, 59):02}:00")]),
                "creation_time": utc(f"2024-01-01 00:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}"),
                "total_bytes_billed": rng.choice([None, 0, rng.randint(1, 5)]),
                "total_slot_ms": i,
            }
        )
    return frame(spark, "jobs", rows)


def test_latest_job_is_the_one_that_ended_last(spark):
    rows = [
        {"job_id": "a", "end_time": utc("2024-01-01 00:00:02"), "total_slot_ms": 1},
        {"job_id": "a", "end_time": utc("2024-01-01 00:00:05"), "total_slot_ms": 2},
        {"job_id": "a", "end_time": None, "total_slot_ms": 3},
        {"job_id": "b", "end_time": None, "total_slot_ms": 4},
        {"job_id": "b", "end_time": None, "total_slot_ms": 5},
    ]
    got = latest_jobs(frame(spark, "jobs", rows)).select("job_id", "total_slot_ms").collect()
    assert {tuple(r) for r in got} == {("a", 2), ("b", 5)}


def test_hot_jobs_are_cut_before_the_shuffle(spark):
    lines = plan(latest_jobs(jobs(spark, 1, 30))).splitlines()
    kinds = [w for line in lines for w in (", Final", ", Partial", "Exchange hashpartitioning") if w in line]
    assert kinds == [", Final", "Exchange hashpartitioning", ", Partial"]


@pytest.mark.parametrize("seed", range(4))
def test_dearest_if_latest_equals_both_ranks_on_one_source(spark, seed):
    src = jobs(spark, seed, 120)
    job_rank = F.row_number().over(Window.partitionBy("job_id").orderBy(*descending(JOB_ORDER)))
    order = [
        F.col("total_bytes_billed").desc_nulls_last(),
        F.col("end_time").desc_nulls_last(),
        F.col("job_id").asc(),
        *descending(["creation_time", "total_slot_ms"]),
    ]
    text_rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    naive = src.withColumns({"a": job_rank, "b": text_rank}).filter("a = 1 AND b = 1")
    # Slot times number the rows.
    expected = {r.total_slot_ms for r in naive.collect()}
    assert expected and {r.total_slot_ms for r in dearest_if_latest(src).collect()} == expected


def test_dearest_run_keeps_one_row_for_unknown_text(spark):
    got = dearest_run_per_text(
        jobs(spark, 5, 90), "query", "total_bytes_billed", [F.col("total_slot_ms")]
    )
    seen = [r.query for r in got.collect()]
    assert len(seen) == len(set(seen)) and None in seen


def test_runs_per_text_has_no_join_and_counts_pairs_in_closed_form(spark):
    src = jobs(spark, 6, 90)
    got = repeats.runs_per_text(src, "query", F.col("total_bytes_billed"))
    assert "Join" not in plan(got)
    pairs = src.alias("a").join(src.alias("b"), F.col("a.query") == F.col("b.query"))
    naive = {r["query"]: r["count"] for r in pairs.groupBy("a.query").count().collect()}
    assert {r.query: r.runs**2 for r in got.collect()} == naive


def test_attach_run_count(spark):
    src = jobs(spark, 7, 300)
    got = repeats.attach_run_count(src, "query", "n")
    per = Window.partitionBy("query")
    naive = src.filter("query IS NOT NULL").withColumn("n", F.count("*").over(per))
    pick = ["job_id", "query", "total_slot_ms", "n"]
    assert sorted(got.select(*pick).collect()) == sorted(naive.select(*pick).collect())
    assert got.columns == [*src.columns, "n"]


def test_run_counts_read_the_source_twice_at_most(spark, tmp_path):
    jobs(spark, 7, 300).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert plan(repeats.attach_run_count(runs, "query", "n")).count("FileScan parquet") <= 2


def test_runs_of_a_crowded_text_are_split_over_tasks(spark, tmp_path):
    """One text holds most rows, another a large tail share; the join splits the former's partition."""
    rows = spark.range(400_000).select(
        "id",
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("tail "), F.col("id") % 3))
        .otherwise(F.concat(F.lit("rare "), F.col("id"))).alias("query"),
        F.sha2(F.col("id").cast("string"), 512).alias("wide"),
    )
    rows.repartition(8).write.parquet(str(tmp_path / "runs"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = repeats.attach_run_count(spark.read.parquet(str(tmp_path / "runs")), "query", "n")
        got = got.agg(F.count("*"), F.sum("n"), F.max("wide").isNotNull())
        expected = 280_000**2 + sum(n * n for n in (26_667, 26_667, 26_666)) + 40_000
        assert [tuple(r) for r in got.collect()] == [(400_000, expected, True)]
        assert "skew=true" in plan(got)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_versions_that_tie_in_the_order_are_settled_alike_in_any_partitioning(spark):
    at = "TIMESTAMP'2024-01-01'"
    rows = spark.range(40).select(
        F.lit("j").alias("job_id"), *[F.expr(at).alias(c) for c in ("end_time", "creation_time", "start_time")],
        F.lit(1).alias("total_slot_ms"), F.lit(2).alias("total_bytes_billed"),
        F.concat(F.lit("u"), "id").alias("user_email"), F.concat(F.lit("q"), "id").alias("query"),
    )
    kept = {latest_jobs(rows.repartition(n, "user_email"), ["query"]).first().query for n in (1, 3, 7, 20)}
    assert len(kept) == 1
