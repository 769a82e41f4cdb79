"""Raw grids into typed tables: header rows, roles, embedded units, transposed sheets, repeated names, filled ids.

A grid is ``(source_id, sheet, row_idx, cells ARRAY<STRING>)``, one row a sheet row, any number of sources at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.elements import header_symbol

#: Rows that summarise, reference standards and notes among sample ids.
SUMMARY_ROW = (
    r"(?i)^\s*(mean|average|avg|std|s\.d\.?|stdev|standard deviation|min|minima|minimum|max|maxima|maximum|median|range|total|sum|"
    r"detection limit|bdl|n\s*=|note:?|notes:?|d\.l\.?|concentrations?\s+in|\(ppm\)|\(ppb\)|\(wt%?\)|numbers?\s+after|\*\s*calculated|"
    r"- not\b|all\s+values?\s+in\b|sample\s*$|sp[a-z]\s+n\s*=)\b"
)
SUMMARY_INSIDE = r"(?i)\(n\s*=\s*[0-9]+\)|\bmean\b|\baverage\b|\bmedian\b|\bstd\b|\bstdev\b|\bmin\b|\bmax\b|\brange\b"
REFERENCE_STANDARD = (
    r"(?i)^\s*([sg]_?nist[0-9]*|nist\s*[0-9]+|mass-?[0-9]|[sg]_?mass[-_]?[0-9]|[sg]_?ge[0-9]+|ge-?[0-9]+|smr\s*[0-9]+|usgs\s*\w+|bhvo-?[0-9]|"
    r"bcr-?[0-9]|gse-?[0-9]|gsd-?[0-9]|reference\s+standard)\s*$"
)
UNIT_TOKENS = ["ppm", "ppb", "wt%", "wt.%", "%", "µg/g", "ug/g", "g/t", "mg/kg"]


#: The length from which an id is a note, that from which a sentence is one, and how notes open.
NOTE_LENGTH, SENTENCE_LENGTH, NOTE_MARKS = 80, 30, ["Note:", "note:", "*", "†", "‡", "§"]


def is_note(value: Column) -> Column:
    """A sample id that reads like a note: blank, overlong, a sentence of several words, or opened by a note mark. Null is one."""
    kinds = [
        lambda t: F.length(t) == 0, lambda t: F.length(t) > NOTE_LENGTH, lambda t: F.exists(F.array(*map(F.lit, NOTE_MARKS)), lambda m: F.startswith(t, m)),
        lambda t: (F.length(t) > SENTENCE_LENGTH) & t.rlike(r"(?s) .*\.$"),
    ]
    return F.coalesce(F.exists(F.array(F.trim(value)), lambda t: reduce(Column.__or__, [k(t) for k in kinds])), F.lit(True))


def is_sample_row(sample_id: Column) -> Column:
    return ~(is_note(sample_id) | sample_id.rlike(SUMMARY_ROW) | sample_id.rlike(SUMMARY_INSIDE) | sample_id.rlike(REFERENCE_STANDARD))


def cells_of(grid: DataFrame) -> DataFrame:
    return grid.select("source_id", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))


def header_rows(grid: DataFrame, first: int = 20, least: int = 2) -> DataFrame:
    """``(source_id, sheet, header_row, symbols)``: of the first rows the one with most element symbols, the earliest on ties.

    Sparse rows (three filled cells or fewer in a sheet wider than five) don't count; sheets without ``least`` symbols give none.
    """
    head = grid.where(F.col("row_idx") < first)
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    ok = head.withColumn("_filled", filled).where(~((F.size("cells") > 5) & (F.col("_filled") <= 3)))
    counted = cells_of(ok).groupBy("source_id", "sheet", "row_idx").agg(F.count(header_symbol(F.col("cell"))).alias("symbols"))
    best = counted.where(F.col("symbols") >= least).groupBy("source_id", "sheet").agg(F.max(F.struct("symbols", (-F.col("row_idx")).alias("r"))).alias("b"))
    return best.select("source_id", "sheet", (-F.col("b.r")).alias("header_row"), F.col("b.symbols").alias("symbols"))


def column_profile(grid: DataFrame) -> DataFrame:
    """Per column below the header: name, symbol, filled share, uniqueness, numeric share; what roles are chosen by."""
    heads = header_rows(grid)
    body = cells_of(grid).join(heads, ["source_id", "sheet"])
    names = body.where("row_idx = header_row").select("source_id", "sheet", "col_idx", F.trim("cell").alias("raw_name"))
    t = F.nullif(F.trim("cell"), F.lit(""))
    stats = body.where("row_idx > header_row").groupBy("source_id", "sheet", "col_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count(t).alias("filled"), F.count_distinct(t).alias("distinct"), F.count(F.when(t.rlike(r"^[<>]?\s*[-+]?[0-9.,]+$"), 1)).alias("numeric")
    )
    p = names.join(stats, ["source_id", "sheet", "col_idx"], "left")
    return p.select(
        "source_id", "sheet", "col_idx", "raw_name", header_symbol(F.col("raw_name")).alias("symbol"),
        (F.coalesce("filled", F.lit(0)) / F.greatest("n", F.lit(1))).alias("coverage"),
        (F.coalesce("distinct", F.lit(0)) / F.greatest("filled", F.lit(1))).alias("uniqueness"),
        (F.coalesce("numeric", F.lit(0)) / F.greatest("filled", F.lit(1))).alias("numeric_share"),
    )


def unique_names(df: DataFrame, keys: list[str], name: str, position: str, out: str) -> DataFrame:
    """Second and later uses of a name get the suffixes _1, _2, … in order of position."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(position)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))


def unpivot_cells(df: DataFrame, ids: list[str], columns: list[str], name: str = "element", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def transpose(cells: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Rows and columns swapped: one row a former column, one column for each of the listed former rows."""
    return cells.groupBy(column).pivot(row, columns).agg(F.first(value, ignorenulls=True))


def local_ids(df: DataFrame, name: str, order: list[str], keys: list[str], out: str = "local_id") -> DataFrame:
    """'name-n' within each repeated name in order; null names give null."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    return df.withColumn(out, F.when(F.col(name).isNotNull(), F.concat_ws("-", F.col(name), n.cast("string"))))


def fill_down(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, below: float = 0.5, least: int = 2) -> DataFrame:
    """The last non-null value above, where fewer than ``below`` and at least ``least`` of the key's rows have one."""
    w = Window.partitionBy(*keys)
    share = F.count(column).over(w) / F.count(F.lit(1)).over(w)
    filled = F.last(column, ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when((share < below) & (F.count(column).over(w) >= least), filled).otherwise(F.col(column)))


def percent_columns(cells: DataFrame, keys: list[str], value: str, low: float, high: float, least: int = 2) -> DataFrame:
    """Per column: is the exact median of its real values between low and high, given ``least`` of them?"""
    real = F.when(F.col(value) >= 0, F.col(value))
    agg = cells.groupBy(*keys).agg(F.count(real).alias("n"), F.median(real).alias("median"))
    return agg.withColumn("is_percent", (F.col("n") >= least) & F.coalesce(F.col("median").between(low, high), F.lit(False)))


def unit_rows(grid: DataFrame, within: int = 3) -> DataFrame:
    """Rows near the top of a sheet that only name units: two or more unit tokens and 30 % of the filled cells."""
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    units = F.size(F.filter(low, lambda c: c.isin(*UNIT_TOKENS)))
    filled = F.size(F.filter(low, lambda c: c != ""))
    kinds = F.array_distinct(F.filter(low, lambda c: c.isin(*UNIT_TOKENS)))
    hit = grid.where(F.col("row_idx") < within).withColumn("units", units).withColumn("filled", filled).where((F.col("units") >= 2) & (F.col("units") >= 0.3 * F.col("filled")))
    return hit.select("source_id", "sheet", "row_idx", F.when(F.size(kinds) > 1, "mixed").when(F.element_at(kinds, 1).contains("%"), "wt%").otherwise(F.element_at(kinds, 1)).alias("unit"))


def explode_list(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row for each item of a comma list; rows whose list is null or blank stay once with null."""
    items = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(out, F.explode_outer(items))


def cap_removal(df: DataFrame, keys: list[str], order: list[str], flag: str, share: float = 0.2) -> DataFrame:
    """Flagged rows removed, earliest first, but at most max(1, share of the rows) of each key."""
    w = Window.partitionBy(*keys)
    cap = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * share).cast("int"))
    rank = F.sum(F.col(flag).cast("int")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_cap", cap).withColumn("_rank", rank).where(~F.col(flag) | (F.col("_rank") > F.col("_cap"))).drop("_cap", "_rank")
