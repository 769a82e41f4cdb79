"""Censored numbers: a cell is a value, below detection (limit known or not) or not measured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The below-detection sentinel and the words for 'below detection' and 'not analysed'.
BELOW_DETECTION = -99999.0
BELOW_WORDS = [
    "bdl", "b.d.l.", "b.d.l", "bdl.", "<dl", "<d.l.", "nd", "n.d.", "n.d", "-", "--", "below detection", "below detection limit",
    "<mdl", "mdl", "<lod", "lod", "b.d.", "bd", "below lod", "below dl", "below mdl",
]
NOT_ANALYSED_WORDS = [
    "n/a", "na", "n.a.", "n.a", "not analyzed", "not analysed", "not measured", "not reported", "not determined", "n.r.", "nr",
]
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_double(text: Column) -> Column:
    """A plain number as a double, else null: no suffix letters, no words."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_cell(cell: Column) -> Column:
    """``struct<value, status, lod>`` of a printed cell; null and 'not analysed' cells have a null status.

    '<L' with L > 0 is below a known limit; '<' before anything else is below an unknown one; '>x' keeps x; thousands commas go.
    """
    t = F.lower(F.trim(cell))
    after_less = F.regexp_extract(t, r"^<\s*([0-9]*\.?[0-9]+)", 1)
    limit = F.when(after_less != "", F.round(after_less.try_cast("double"), 6))
    rest = F.when(F.startswith(t, F.lit(">")), F.trim(F.substring(t, 2, 1 << 20))).otherwise(t)
    number = F.round(strict_double(F.replace(rest, F.lit(","))), 6)
    blank = cell.isNull() | (t == "") | t.isin(*NOT_ANALYSED_WORDS)
    status = (
        F.when(blank, None)
        .when(t.isin(*BELOW_WORDS), "bdl")
        .when(F.startswith(t, F.lit("<")), F.when(limit > 0, "bdl_lod").otherwise("bdl"))
        .when(number.isNotNull(), "value")
    )
    return F.struct(
        F.when(status == "value", number).alias("value"), status.alias("status"), F.when(status == "bdl_lod", limit).alias("lod")
    )


def as_sentinel(cell: Column) -> Column:
    """The parsed struct folded into one double: the value, -99999 below detection, minus the limit if it is known."""
    return F.when(cell["status"] == "value", cell["value"]).when(cell["status"] == "bdl_lod", -cell["lod"]).when(cell["status"] == "bdl", BELOW_DETECTION)


def convert(cell: Column, factor: Column) -> Column:
    """A parsed cell in another unit: values and known limits scale, the state stays."""
    return F.struct((cell["value"] * factor).alias("value"), cell["status"].alias("status"), (cell["lod"] * factor).alias("lod"))
