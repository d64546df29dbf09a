"""The stream's buckets are the batch report's."""

import pytest
from pyspark.sql import functions as F

from slotwise.plans import slots
from slotwise.sources.layout import write_table
from slotwise.streaming.timeline import slots_by_stream
from slotwise import schemas

AS_OF = "2024-01-31 00:00:00"


def test_stream_equals_batch_over_the_same_rows(spark, warehouse, tmp_path):
    timeline = warehouse.jobs_timeline.dropDuplicates(["job_id", "period_start", "state"])
    write_table(timeline, str(tmp_path / "in"), "jobs_timeline")
    batch = slots.slots_by_hour(
        type(warehouse).from_frames(spark, {"jobs_timeline": timeline}), as_of=AS_OF, days=40
    ).filter(F.col("slot_usage") > 0)
    stream = (
        spark.readStream.schema(schemas.ddl("jobs_timeline"))
        .parquet(str(tmp_path / "in" / "jobs_timeline"))
    )
    query = (
        slots_by_stream(stream, "hour", delay="40 days")
        .writeStream.format("memory").queryName("hours").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    got = spark.table("hours").filter(F.col("slot_usage") > 0)
    pick = ["timeInterval_PST", "slot_usage"]
    assert got.count() > 100
    assert got.select(pick).exceptAll(batch.select(pick)).isEmpty()
    assert batch.select(pick).exceptAll(got.select(pick)).isEmpty()


def test_days_are_not_streamed(warehouse):
    with pytest.raises(ValueError):
        slots_by_stream(warehouse.jobs_timeline, "day")


def test_append_mode_issues_a_bucket_once_and_drops_late_rows(spark, tmp_path):
    """Each batch is a file; a bucket comes out when the watermark has passed its end."""
    from tests.helpers import frame, utc

    def arrive(n, *rows):
        seconds = [
            {"job_id": job, "period_start": utc(at), "state": "RUNNING", "statement_type": "SELECT", "period_slot_ms": ms}
            for job, at, ms in rows
        ]
        frame(spark, "jobs_timeline", seconds).select(*schemas.ALL["jobs_timeline"]).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
        query = (
            slots_by_stream(spark.readStream.schema(schemas.ddl("jobs_timeline")).parquet(str(tmp_path / "in")), "minute", delay="10 minutes")
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        out = spark.read.parquet(str(tmp_path / "out")) if (tmp_path / "out" / "_spark_metadata").exists() else None
        return [] if out is None else sorted(round(r.slot_usage, 3) for r in out.collect())

    assert arrive(1, ("a", "2024-01-30 10:00:01", 60_000), ("b", "2024-01-30 10:00:02", 60_000)) == []
    assert arrive(2, ("c", "2024-01-30 11:00:00", 60_000)) == [2.0]  # ten o'clock is closed
    assert arrive(3, ("d", "2024-01-30 10:00:03", 60_000), ("e", "2024-01-30 12:00:00", 0)) == [1.0, 2.0]  # d is late
