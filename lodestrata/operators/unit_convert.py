"""Quantities recorded in different units, converted to one common unit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.units import UnitIndex, stated_unit
from lodestrata.session import checkpointed

#: A cell up to the end of its first number (no power of ten like 10^3), and that number with its sign.
NUMBER = r"\A[^0-9]*[0-9][0-9.,]*+(?:[eE][-+]?[0-9]{1,3}+)?+(?!\^)"
_SIGNED = r"[-−–]?[0-9][0-9.,]*(?:[eE][-+]?[0-9]+)?\z"
#: What may follow the number before a unit: an uncertainty and footnote marks.
_AFTER = r"\A\s*(?:(?:±|\+/-|\+-)\s*[0-9.,]++(?:[eE][-+]?[0-9]{1,3}+)?+)?[\s*†‡§]*(?:\((?:[0-9]\s*)?(?:σ|sigma|s\.?d\.?)\))?[\s*†‡§]*"


def with_number(df: DataFrame, cell: str) -> DataFrame:
    """``df`` with ``_number``, the first number of a cell as a double, and ``_s_value``, what the cell says after it.

    Cells opening with < or >, negative numbers and texts give a null number. A comma before groups of exactly three digits is
    a thousands mark, any other a decimal mark. An uncertainty and footnote marks after the number are passed over.
    """
    upto = F.regexp_extract(F.col(cell), NUMBER, 0)
    df = df.withColumn("_upto", upto).withColumn("_rest", F.expr(f"substring(`{cell}`, length(_upto) + 1)"))
    df = df.withColumn("_digits", F.when(F.col("_upto").rlike(r"\A[0-9]+\z"), F.col("_upto")).otherwise(F.regexp_extract("_upto", _SIGNED, 0)))
    d = F.regexp_replace("_digits", r"[.,]+(?=\z|[eE])", "")
    plain = (
        F.when(~F.contains("_digits", F.lit(",")), F.col("_digits"))
        .when(d.rlike(r"\A[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?(?:[eE].*)?\z"), F.replace(d, F.lit(",")))
        .otherwise(F.replace(d, F.lit(","), F.lit(".")))
    )
    negative = F.col("_digits").rlike(r"\A[-−–]")
    number = F.when((F.col("_digits") != "") & ~negative & ~F.ltrim(cell).rlike(r"\A[<>]"), plain.try_cast("double"))
    rest = F.when(F.trim("_rest") == "", None).otherwise(F.trim(F.regexp_replace("_rest", _AFTER, "")))
    return df.withColumn("_number", number).withColumn("_s_value", F.when(rest != "", rest)).drop("_upto", "_rest", "_digits")


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = UnitIndex()
    for b in batches:
        got = [stated_unit(s, t, index) for s, t in zip(b["source"], b["text"])]
        yield b.assign(ppb=[x and x[0] for x in got], plain_ppm=[x and x[1] for x in got])


def alias_dictionary(rows: DataFrame, sources: dict[str, str]) -> DataFrame:
    """``(source, text, n, ppb, plain_ppm)`` for each distinct text and how often it stands there; ppb is null where it states no
    unit. ``sources``: source -> column.

    Distinct spellings are counted map-side before they are resolved, each once, through the n-gram index.
    """
    pairs = [F.struct(F.lit(s).alias("source"), F.col(c).alias("text")) for s, c in sources.items()]
    spelt = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.source", "p.text").where("text IS NOT NULL")
    return spelt.groupBy("source", "text").agg(F.count(F.lit(1)).alias("n")).mapInPandas(_resolve, "source string, text string, n bigint, ppb double, plain_ppm boolean")


def convert_units(rows: DataFrame, value: str, unit: str, header: str, note: str, hot_share: int = 8_000) -> DataFrame:
    """``rows`` with ``_number``, ``_ppb`` (of the first place that states a unit: the cell, unit, header, note) and ``_plain_ppm``.

    Null or unreadable cells have a null ``_number``, rows without a known unit a null ``_ppb``. Null texts state nothing; all
    rows stay, repeated ones included.

    The dictionary joins in two parts. Texts that make up more than one in ``hot_share`` of all are broadcast, those that state
    nothing too: there can be no more than ``hot_share`` of them. They settle most rows, and take every hot key out of the
    rest. Rows whose unit depends on a rare text meet the rare part by shuffle, where null and settled texts are spread evenly.
    """
    sources = {"value": "_s_value", "unit": unit, "header": header, "note": note}
    shaped = with_number(rows, value)
    known = checkpointed(alias_dictionary(shaped, sources))
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / hot_share

    def part(s: str, which: Column) -> DataFrame:
        return known.where((F.col("source") == s) & which).select(F.col("text").alias(f"_t_{s}"), F.struct("ppb", "plain_ppm").alias(f"_u_{s}"))

    out = shaped
    for s, c in sources.items():
        out = out.join(F.broadcast(part(s, hot)), F.col(c) == F.col(f"_t_{s}"), "left")
    none = F.lit(None).cast("struct<open:boolean,ppb:double,plain_ppm:boolean>")
    # of each place: what it states, null if nothing, or that only the rare part can tell
    said = {
        s: F.when(F.col(f"_u_{s}.ppb").isNotNull(), F.struct(F.lit(False).alias("open"), F.col(f"_u_{s}.ppb").alias("ppb"), F.col(f"_u_{s}.plain_ppm").alias("plain_ppm")))
        .when(F.col(c).isNotNull() & F.col(f"_t_{s}").isNull(), F.struct(F.lit(True).alias("open"), F.lit(None).cast("double").alias("ppb"), F.lit(None).cast("boolean").alias("plain_ppm")))
        .otherwise(none)
        for s, c in sources.items()
    }
    out = out.withColumn("_first", F.coalesce(*said.values()))
    open_ = F.coalesce(F.col("_first.open"), F.lit(False))
    drop = [f"{p}{s}" for s in sources for p in ("_t_", "_u_")] + ["_s_value", "_first"]
    settled = out.where(~open_).withColumn("_ppb", F.col("_first.ppb")).withColumn("_plain_ppm", F.col("_first.plain_ppm")).drop(*drop)

    rest = out.where(open_).drop("_first")
    seed = F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t])
    for s, c in sources.items():
        rare = part(s, ~hot & F.col("ppb").isNotNull()).select(F.col(f"_t_{s}").alias(f"_k_{s}"), F.col(f"_u_{s}").alias(f"_r_{s}"))
        key = F.when(F.col(c).isNotNull() & F.col(f"_t_{s}").isNull(), F.col(c)).otherwise(F.concat(F.lit("\x00"), F.pmod(seed, F.lit(4096)).cast("string")))
        rest = rest.withColumn("_key", key).join(rare.hint("merge"), F.col("_key") == F.col(f"_k_{s}"), "left").drop("_key", f"_k_{s}")
    hit = F.coalesce(*[x for s in sources for x in (F.col(f"_r_{s}"), F.when(F.col(f"_u_{s}.ppb").isNotNull(), F.col(f"_u_{s}")))])
    found = rest.withColumn("_ppb", hit["ppb"]).withColumn("_plain_ppm", hit["plain_ppm"]).drop(*drop, *[f"_r_{s}" for s in sources])
    return settled.unionByName(found)


def measured_ppb(measurements: DataFrame) -> DataFrame:
    """``(meas_id, value_ppb)`` of the measurements in a known unit other than plain ppm, each once."""
    m = measurements.select("meas_id", "original_value", "unit", "column_header", "note")
    c = convert_units(m, "original_value", "unit", "column_header", "note")
    # one null check on the product: a filter on _number alone would be pushed to the scan with its whole parsing written out
    value = F.round(F.col("_number") * F.col("_ppb")).cast("bigint")
    return c.where(~F.coalesce("_plain_ppm", F.lit(True))).select("meas_id", value.alias("value_ppb")).where("value_ppb IS NOT NULL").distinct()
