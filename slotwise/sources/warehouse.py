"""The input tables as one object, read from files or from a catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise import schemas
from slotwise.params import utc_session


class Warehouse:
    """Attribute access to the eleven input tables; each is resolved on first use.

    Every report takes one. ``from_frames`` wraps DataFrames that exist already.
    The session's time zone is set to UTC, for the caller's other queries too.
    """

    def __init__(self, spark: SparkSession, resolve: Callable[[str], DataFrame]):
        self.spark = utc_session(spark)
        self._resolve = resolve
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schemas.ALL:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._resolve(name)
        return self._tables[name]

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> Warehouse:
        return cls(spark, frames.__getitem__)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, fmt: str = "parquet") -> Warehouse:
        """One folder per table under ``root``, in any format Spark reads.

        The declared schema is used, so no file is opened to infer one. The ``*_day``
        folders of a table laid out by day are found by Spark and add their column.
        """
        return cls(
            spark,
            lambda name: spark.read.schema(schemas.ddl(name)).format(fmt).load(f"{root}/{name}"),
        )

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Warehouse:
        """Tables or views of the same names in a catalog database."""
        return cls(spark, lambda name: spark.table(f"{database}.{name}"))

