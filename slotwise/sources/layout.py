"""Writing telemetry so that a look-back reads only its own days or months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The column each large table is laid out by, on which reports filter first, and the
# length of its folders. Logs with many rows a day have day folders. A table whose
# history spans years with few rows a day has month folders: listing thousands of
# folders would cost more than reading the week that is wanted, and within a file the
# row groups' statistics lead to the days.
LAYOUT = {
    "jobs": ("creation_time", "day"),
    "jobs_timeline": ("period_start", "day"),
    "reservations_timeline": ("period_start", "day"),
    "audit_log": ("timestamp", "day"),
    "table_storage_usage": ("usage_date", "month"),
}


def folder_column(table: str) -> str | None:
    return "_".join(LAYOUT[table]) if table in LAYOUT else None


def folder_of(ts: Column, length: str) -> Column:
    """The date that names the folder of an instant or date."""
    return F.to_date(ts) if length == "day" else F.trunc(F.to_date(ts), length)


def write_table(
    df: DataFrame, root: str, table: str, fmt: str = "parquet", *, days_only: bool = False
) -> None:
    """Write one table under ``root``, in day or month folders if it is a telemetry log.

    ``days_only`` replaces just the days that occur in ``df`` and leaves all others,
    as for a log that grows daily; without it the whole table is replaced. In month
    folders the other days of the months that occur are written again with them;
    the old files stay in place until the new ones are complete.

    Rows are ranged by time before the write: each task writes few folders, and a busy
    day is split over several tasks. Within a file, rows are in time order, so the
    row-group statistics serve the finer bounds of a look-back.
    """
    target = f"{root}/{table}"
    if table not in LAYOUT:
        if days_only:
            raise ValueError(f"{table} is not laid out by day")
        df.write.mode("overwrite").format(fmt).save(target)
        return
    ts, length = LAYOUT[table]
    folder = folder_column(table)
    df = df.withColumn(folder, folder_of(F.col(ts), length))
    if days_only and length != "day":
        there = df.sparkSession.read.schema(df.schema).format(fmt).load(target)
        new = df.select(F.to_date(ts).alias("_day"), F.col(folder).alias("_folder")).distinct()
        same_folder = there.join(new.select("_folder").distinct(), F.col(folder) == F.col("_folder"), "left_semi")
        df = df.unionByName(same_folder.join(new, F.to_date(ts) == F.col("_day"), "left_anti"))
    (
        df.repartitionByRange(folder, ts)
        .sortWithinPartitions(folder, ts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if days_only else "static")
        .partitionBy(folder)
        .format(fmt)
        .save(target)
    )
