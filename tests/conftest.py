import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("slotwise-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def warehouse(spark):
    """The derived tables of the smallest scale factor."""
    from checks.derive import derived_warehouse

    return derived_warehouse(spark, SMALL)


@pytest.fixture(scope="session")
def laid_out(spark, warehouse, tmp_path_factory):
    """The same tables written in day folders and read back."""
    from slotwise import Warehouse, schemas
    from slotwise.sources.layout import write_table

    root = str(tmp_path_factory.mktemp("tables"))
    for table in schemas.ALL:
        write_table(getattr(warehouse, table), root, table)
    return Warehouse.from_path(spark, root)
