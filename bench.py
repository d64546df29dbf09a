"""Time every report on telemetry tables laid out by day.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--root FOLDER] [name ...]

The tables are derived from the given ones and written once, to new folders under
``--root`` (else to a temporary one); that is reported apart as ``setup``. Each report is then planned and run in full,
every row and column of it, with its default parameters. Prints one JSON line.
"""

from __future__ import annotations

import argparse
import json
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from checks import derive, registry
from slotwise import schemas
from slotwise.sources.layout import write_table
from slotwise.sources.warehouse import Warehouse

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("slotwise-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def laid_out(spark: SparkSession, root: str) -> Warehouse:
    source = derive.derived_warehouse(spark, SF_DIR, spread=CPUS)
    for table in schemas.ALL:
        write_table(getattr(source, table), root, table)
    return Warehouse.from_path(spark, root)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    options = argparse.ArgumentParser()
    options.add_argument("--root")
    options.add_argument("names", nargs="*")
    given = options.parse_args()
    spark = session()
    start = time.perf_counter()
    root = f"{given.root.rstrip('/')}/bench-{uuid.uuid4().hex}" if given.root else tempfile.mkdtemp(prefix="run-bench-")
    wh = laid_out(spark, root)
    setup = time.perf_counter() - start

    reports = registry.reports()
    wanted = given.names or [name for name in reports if "__" not in name]
    for name in ("slots_by_minute", "general_job_information", "audit_slots_by_minute"):
        run(reports[name](wh))  # warm the JVM and the file cache
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        run(reports[name](wh))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_report_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup": round(setup, 1),
                "cpus": CPUS,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
