"""Small frames from Python rows, and plain results."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from slotwise import schemas


def utc(text):
    """An instant in UTC, whatever the machine's time zone."""
    return None if text is None else datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def frame(spark, table, rows):
    """Rows of an input table; columns left out are NULL."""
    kinds = schemas.ALL[table]
    wanted = list(dict.fromkeys(c for row in rows for c in row))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in wanted)
    df = spark.createDataFrame([tuple(r.get(c) for c in wanted) for r in rows], schema)
    missing = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in wanted}
    return df.withColumns(missing) if missing else df


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(df, *columns):
    """Rows as tuples, with instants and dates as text."""
    picked = [F.col(c).cast("string") if "time" in t or "date" in t else F.col(c)
              for c, t in df.dtypes if not columns or c in columns]
    return [tuple(r) for r in df.select(*picked).collect()]
