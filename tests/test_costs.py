"""Units, slots, prices and texts, by hand."""

import pytest
from pyspark.sql import functions as F

from slotwise import fixed_values as fv
from slotwise.functions import costs, texts
from slotwise.params import Prices, instant, per_slot_second
from tests.helpers import value

lit = F.lit


def null():
    return lit(None).cast("bigint")


def row(spark, columns):
    return tuple(spark.range(1).select(*columns).first())


def test_byte_ladder(spark):
    assert row(spark, costs.byte_ladder(lit(3 * fv.GIB + fv.GIB // 8))) == (
        3355443200.0, 3200.0, 3.13, 0.0,
    )
    assert row(spark, costs.byte_ladder(null())) == (0.0, 0.0, 0.0, 0.0)


def test_on_demand(spark):
    assert value(spark, costs.on_demand(lit(fv.TIB), 6.25)) == 6.25
    assert value(spark, costs.on_demand(null(), 6.25)) is None


def test_slot_rate(spark):
    a, b = instant("2024-01-01 00:00:00"), instant("2024-01-01 00:00:02")
    assert value(spark, costs.slot_rate(lit(5000), a, b)) == 2.5
    assert value(spark, costs.slot_rate(lit(5000), a, b, inverted=True)) == 0.4
    assert value(spark, costs.slot_rate(lit(5000), a, a)) is None
    assert value(spark, costs.slot_rate(lit(0), a, b, inverted=True)) is None


def test_nano_ratio_is_exact(spark):
    assert value(spark, costs.nano_ratio(lit(10), lit(3))) == 3_333_333_333
    big = lit(9_000_000_000_000_000)
    assert value(spark, costs.nano_ratio(big, lit(3_600_000))) == 2_500_000_000_000_000_000
    assert value(spark, costs.nano_ratio(lit(1), lit(0))) is None


@pytest.mark.parametrize("slots, stepped", [(0.0, 0.0), (0.01, 50.0), (50.0, 50.0), (50.01, 100.0)])
def test_step_up(spark, slots, stepped):
    assert value(spark, costs.step_up(lit(slots))) == stepped


def test_billed_hours(spark):
    assert value(spark, costs.billed_hours(lit(1))) == 60_000 / 3_600_000
    assert value(spark, costs.billed_hours(lit(7_200_000))) == 2.0
    assert value(spark, costs.billed_hours(null())) is None


def test_at_least_keeps_null(spark):
    assert value(spark, costs.at_least(lit(5), 10)) == 10
    assert value(spark, costs.at_least(lit(15), 10)) == 15
    assert value(spark, costs.at_least(null(), 10)) is None


def test_edition_rates(spark):
    p = Prices.us()

    def rate(edition, literal=False):
        return value(spark, costs.edition_slot_second(lit(edition), p, literal=literal))

    assert rate("ENTERPRISE_PLUS") == rate("ENTERPRISE PLUS") == per_slot_second(0.10)
    assert rate("ENTERPRISE_PLUS", literal=True) is None
    assert str(rate("STANDARD")) == "0.000011111"
    assert rate("OTHER") is None


def test_sum_bytes_beyond_64_bits(spark):
    many = spark.range(4).select(lit(2**62).alias("b"))
    assert int(many.agg(costs.sum_bytes(F.col("b"))).first()[0]) == 2**64


def test_money(spark):
    assert value(spark, texts.money(lit(1234.5))) == "$ 1,234.50"
    assert value(spark, texts.money(lit(-0.4))) == "$ -0.40"
    assert value(spark, texts.money(lit(None).cast("double"))) is None


@pytest.mark.parametrize(
    "nbytes, shown",
    [(0, "0.00 KB"), (512, "0.50 KB"), (fv.MIB, "1.00 MiB"), (fv.GIB // 8 * 9, "1.12 GiB"),
     (fv.TIB * 2000, "2000.00 TiB"), (None, None)],
)
def test_readable_size(spark, nbytes, shown):
    assert value(spark, texts.readable_size(lit(nbytes).cast("bigint"))) == shown


@pytest.mark.parametrize(
    "model, logical, physical, advice, statement",
    [
        ("LOGICAL", 1.0, 2.0, fv.KEEP_LOGICAL, None),
        ("LOGICAL", 2.0, 1.0, fv.GO_PHYSICAL, "PHYSICAL"),
        ("LOGICAL", 1.0, 1.0, fv.GO_PHYSICAL, "PHYSICAL"),
        ("PHYSICAL", 1.0, 2.0, fv.GO_LOGICAL, "LOGICAL"),
        ("PHYSICAL", 2.0, 1.0, fv.KEEP_PHYSICAL, None),
    ],
)
def test_storage_advice(spark, model, logical, physical, advice, statement):
    compared = (lit(model), lit(logical), lit(physical))
    assert value(spark, texts.storage_advice(*compared)) == advice
    ddl = value(spark, texts.storage_ddl(lit("p.d"), *compared, "region-eu"))
    if statement is None:
        assert ddl is None
    else:
        assert ddl == (
            "SET @@location = 'eu';\n"
            f"ALTER SCHEMA `p.d` SET OPTIONS(storage_billing_model = '{statement}')"
        )


def test_eu_prices_differ_in_physical_storage_only():
    us, eu = Prices.us(), Prices.eu()
    assert (eu.active_physical, eu.long_term_physical) == (0.044, 0.022)
    assert (eu.active_logical, eu.on_demand) == (us.active_logical, us.on_demand)
