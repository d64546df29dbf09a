"""Money, sizes and change statements as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise import fixed_values as fv


def money(amount: Column) -> Column:
    """``$ 1,234.50``; NULL stays NULL."""
    return F.concat(F.lit("$ "), F.format_number(amount.cast("double"), 2))


def readable_size(nbytes: Column) -> Column:
    """``1.23 GiB``, in the largest unit that fits and KB at the least."""

    def text(unit: int, name: str) -> Column:
        # The pattern has no grouping and rounds halves to even, as %.2f does.
        amount = F.call_function(
            "format_number", nbytes.cast("double") / F.lit(float(unit)), F.lit("0.00")
        )
        return F.concat(amount, F.lit(f" {name}"))

    return (
        F.when(nbytes >= fv.TIB, text(fv.TIB, "TiB"))
        .when(nbytes >= fv.GIB, text(fv.GIB, "GiB"))
        .when(nbytes >= fv.MIB, text(fv.MIB, "MiB"))
        .otherwise(text(fv.KIB, "KB"))
    )


def storage_advice(model: Column, logical: Column, physical: Column) -> Column:
    on_logical = F.coalesce(model == "LOGICAL", F.lit(False))
    logical_wins = F.coalesce(logical < physical, F.lit(False))
    return (
        F.when(on_logical & logical_wins, F.lit(fv.KEEP_LOGICAL))
        .when(on_logical, F.lit(fv.GO_PHYSICAL))
        .when(logical_wins, F.lit(fv.GO_LOGICAL))
        .otherwise(F.lit(fv.KEEP_PHYSICAL))
    )


def storage_ddl(
    dataset: Column, model: Column, logical: Column, physical: Column, location: str
) -> Column:
    """The statement that makes the advised change, NULL where nothing should change."""
    on_logical = F.coalesce(model == "LOGICAL", F.lit(False))
    logical_wins = F.coalesce(logical < physical, F.lit(False))
    place = fv.SET_LOCATION.replace("<location>", location.replace("region-", ""))

    def statement(template: str) -> Column:
        before, after = template.split("<dataset>")
        return F.concat(F.lit(place + before), dataset, F.lit(after))

    return F.when(on_logical & ~logical_wins, statement(fv.SET_PHYSICAL)).when(
        ~on_logical & logical_wins, statement(fv.SET_LOGICAL)
    )
