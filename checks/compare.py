"""Run registered queries and their oracles on the same files and compare the rows.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks import duck_reports, registry

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in GIVEN:
        path = f"{sf_dir}/{table}.parquet"
        if Path(path).exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("slotwise")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs first, or None if the rows are exactly equal in any order."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(mine.columns) ^ set(theirs.columns))}"
    a, b = rows(mine), rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows, oracle {len(b)}"
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            names = sorted(mine.columns)
            parts = [f"{n}: {p!r} / {q!r}" for n, p, q in zip(names, x, y) if p != q]
            return f"row {i}: " + "; ".join(parts)
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = session(), connect(args.sf)
    oracles = duck_reports.oracle_sql()
    failures = 0
    for name, query in registry.queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            mine = query(spark, args.sf).toPandas()
            took = time.time() - start
            found = difference(mine, con.execute(oracles[name]).df())
            size = len(mine)
        except Exception as error:  # report and go on to the next
            took, found, size = time.time() - start, str(error).strip()[:600], -1
        failures += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {size} {took:.1f}s {found or ''}", flush=True)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
