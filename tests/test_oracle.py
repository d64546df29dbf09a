"""Every registered query against its SQL on the smallest scale factor, exactly."""

import pytest

from checks import duck_reports, registry
from checks.compare import connect, difference
from tests.conftest import SMALL

QUERIES, ORACLES = registry.queries(), duck_reports.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_every_report_is_registered():
    names = {n.split("__")[0] for n in QUERIES}
    assert len(names) == 93
    assert len([n for n in names if not n.startswith("audit_")]) == 40
    assert len([n for n in names if n.endswith("_general")]) == 25


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_report_equals_oracle(laid_out, duck, name):
    """On the tables as written and read back: derived once, scanned by every report."""
    mine = registry.flat(name, registry.reports()[name](laid_out)).toPandas()
    assert difference(mine, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["slots_by_minute", "audit_general_job_information"])
def test_registered_query_equals_oracle(spark, duck, name):
    mine = QUERIES[name](spark, SMALL).toPandas()
    assert difference(mine, duck.execute(ORACLES[name]).df()) is None
