"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Trimmed text with runs of spaces and tabs as one space; empty becomes null."""
    squeezed = F.regexp_replace(F.regexp_replace(c.cast("string"), r"[ \t]+", " "), r"^[\s ]+|[\s ]+$", "")
    return F.when(squeezed != "", squeezed)


def differs(a: Column, b: Column, kind: str, rel_tol: float = 1e-9) -> Column:
    """True where the two normalised values differ; null differs from any value, two nulls are alike.

    Doubles differ beyond ``rel_tol`` of the larger magnitude; two NaN are alike, and a NaN differs from a number.
    """
    if kind in ("double", "float"):
        gap = F.abs(a - b) > F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b))
        value = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) != F.isnan(b)).when(a == b, False).otherwise(gap)
    else:
        value = a != b
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(value)


def latest_per_key(df: DataFrame, key: Column, fields: list[str], order: list[str]) -> DataFrame:
    """One row per normalised key: the greatest by ``order``, ties settled by the field values.

    The key is carried as (``_k``, ``_knull``), both never null, so that a plain equi-join on them is null-safe and
    reuses this aggregation's partitioning. Aggregates map-side: a hot key costs one row per task.
    """
    kinds = dict(df.dtypes)
    shaped = [
        (clean_text(F.col(f"`{f}`")) if kinds[f] == "string" else F.col(f"`{f}`")).alias(f"f{i}")
        for i, f in enumerate(fields)
    ]
    rows = df.select(
        F.coalesce(key.cast("string"), F.lit("")).alias("_k"),
        key.isNull().alias("_knull"),
        F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"),
        F.struct(*shaped).alias("_v"),
    )
    return rows.groupBy("_k", "_knull").agg(F.max(F.struct("_o", "_v"))["_v"].alias("_v"))


def table_diff(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, fields: list[str], order: list[str]
) -> DataFrame:
    """Null-safe full outer join of the two copies on a normalised key.

    Returns ``(key, side, diffs)``: side 'both', 'left' or 'right', and diffs an array of
    ``struct<field, left, right>`` with the fields whose normalised values differ (empty for one-sided keys).
    A null key is a key of its own; of repeated keys the row greatest by ``order`` counts. Columns other than ``fields``
    and ``order`` are ignored, whatever their names. Empty tables give only the other side's keys.
    """
    kinds = dict(left.dtypes)
    a = latest_per_key(left, left_key, fields, order).withColumnRenamed("_v", "_a")
    b = latest_per_key(right, right_key, fields, order).withColumnRenamed("_v", "_b")
    joined = a.join(b, ["_k", "_knull"], "full_outer")
    cells = []
    for i, f in enumerate(fields):
        x, y = F.col(f"_a.f{i}"), F.col(f"_b.f{i}")
        cells.append(
            F.when(
                differs(x, y, kinds[f]),
                F.struct(F.lit(f).alias("field"), x.cast("string").alias("left"), y.cast("string").alias("right")),
            )
        )
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    none = F.array().cast("array<struct<field:string,left:string,right:string>>")
    return joined.select(
        F.when(~F.col("_knull"), F.col("_k")).alias("key"),
        side.alias("side"),
        F.when(side == "both", F.array_compact(F.array(*cells))).otherwise(none).alias("diffs"),
    )


#: Fields compared between the two copies of the sheet.
SHEET_FIELDS = [
    "sample_name", "deposit_name", "deposit_type_original", "mineral", "analytical_method",
    "zn_ppm", "fe_ppm", "cd_ppm", "ge_ppm", "publication_date",
]


def sheet_key(name: str = "analysis_id") -> Column:
    return F.upper(F.regexp_replace(F.col(name), r"^[\s ]+|[\s ]+$", ""))


def sheet_issues(golden: DataFrame, extraction: DataFrame) -> DataFrame:
    """``(analysis_id, issue)``: keys on one side only and, for common keys, each differing field. Null ids are left out."""
    key = sheet_key()
    order = ["last_update", "row_id"]
    d = table_diff(
        golden.where(F.col("analysis_id").isNotNull()),
        extraction.where(F.col("analysis_id").isNotNull()),
        key, key, SHEET_FIELDS, order,
    )
    issues = (
        F.when(F.col("side") == "left", F.array(F.lit("only_golden")))
        .when(F.col("side") == "right", F.array(F.lit("only_extraction")))
        .otherwise(F.transform("diffs", lambda x: x["field"]))
    )
    return d.select(F.col("key").alias("analysis_id"), F.explode(issues).alias("issue"))
