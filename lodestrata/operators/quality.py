"""Quality of extracted tables without a truth, registries of documents, ids and small derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.censored import BELOW_DETECTION, BELOW_WORDS, NOT_ANALYSED_WORDS
from lodestrata.operators.scoring import MAJOR_CEILING, MAJOR_ELEMENTS, TRACE_CEILING

#: Weights of metadata, elements, ids, plausibility and consistency; words of known methods and minerals; the years that may be.
QUALITY_WEIGHTS = (0.20, 0.15, 0.20, 0.25, 0.20)
KNOWN_METHODS = ["epma", "la-icpms", "la-icp-ms", "icp-ms", "icpms", "xrf", "sem-eds", "pixe", "inaa", "sims", "empa", "la icpms", "electron microprobe", "laser ablation"]
KNOWN_MINERALS = [
    "pyrite", "chalcopyrite", "sphalerite", "galena", "arsenopyrite", "pyrrhotite", "magnetite", "hematite", "bornite", "chalcocite", "covellite", "enargite", "tetrahedrite", "tennantite",
    "molybdenite", "cassiterite", "wolframite", "scheelite", "pentlandite", "millerite", "stannite", "bournonite", "sulfosalt",
]
YEARS = (1990, 2030)
NO_VALUE = ["nan", "none", ""]


def _given(c: str) -> Column:
    t = F.trim(F.col(c).cast("string"))
    return F.when(~F.lower(t).isin(*NO_VALUE), t)


def year_of(text: Column) -> Column:
    """The first four digits in a row as a year; null for a text without any."""
    return F.nullif(F.regexp_extract(text.cast("string"), r"([0-9]{4})", 1), F.lit("")).try_cast("int")


def quality_scores(rows: DataFrame, keys: list[str], order: list[str], metadata: list[str], elements: dict[str, str], ids: list[str], method: str, mineral: str, year: str, tracked: int = 73) -> DataFrame:
    """One row a report: row count, five scores from 0 to 1 and the weighted quality, with a list of what is amiss.

    Metadata and consistency look at the report's first row in ``order``. Elements (symbol -> column) are counted against the
    ``tracked`` symbols. Ids are judged by the first id column with any: half by how many are distinct, half by how many rows have
    one. Plausible is an element whose real values stay under its ceiling; one that is all below detection is. A mineral that is
    not listed counts half. Everything is one aggregate that combines map-side; only the distinct ids need the report's rows.
    """
    values = {e: F.col(c).cast("double") for e, c in elements.items()}
    real = {e: F.when((v >= 0) & (v != BELOW_DETECTION), v) for e, v in values.items()}
    first = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*[_given(c).alias(c) for c in dict.fromkeys([*metadata, method, mineral, year])]).alias("v")))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), first.alias("_first"), *[F.count(v).alias(f"_n_{e}") for e, v in values.items()], *[F.max(r).alias(f"_m_{e}") for e, r in real.items()],
        *[F.count(_given(c)).alias(f"_c_{i}") for i, c in enumerate(ids)], *[F.count_distinct(_given(c)).alias(f"_u_{i}") for i, c in enumerate(ids)],
    )
    v = lambda c: F.col(f"_first.v.{c}")
    share = lambda parts, n: sum(p.cast("double") for p in parts) / F.lit(float(n))
    meta = share([v(c).isNotNull() for c in metadata], len(metadata))
    measured = [F.col(f"_n_{e}") > 0 for e in elements]
    complete = share(measured, tracked)
    id_score, id_note = F.lit(0.0), F.lit("no sample ids")
    for i in reversed(range(len(ids))):
        n, u = F.col(f"_c_{i}"), F.col(f"_u_{i}")
        id_score = F.when(n > 0, F.least(F.lit(1.0), 0.5 * u / n + 0.5 * n / F.col("rows"))).otherwise(id_score)
        id_note = F.when(n > 0, F.when((u / n < 0.5) & (n > 5), F.lit(f"few distinct ids in {ids[i]}"))).otherwise(id_note)
    ceiling = {e: MAJOR_CEILING if e in MAJOR_ELEMENTS else TRACE_CEILING for e in elements}
    high = {e: F.coalesce(F.col(f"_m_{e}") > ceiling[e], F.lit(False)) for e in elements}
    checked = sum(m.cast("int") for m in measured)
    passed = sum((m & ~high[e]).cast("int") for e, m in zip(elements, measured))
    plausible = F.when(checked > 0, passed / checked).otherwise(1.0)
    within = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(v(c)), w))
    y = year_of(v(year))
    checks = [
        F.when(v(method).isNotNull(), within(method, KNOWN_METHODS).cast("double")),
        F.when(v(mineral).isNotNull(), F.when(within(mineral, KNOWN_MINERALS), 1.0).otherwise(0.5)),
        F.when(v(year).isNotNull(), F.coalesce(y.between(*YEARS).cast("double"), F.lit(0.0))),
    ]
    listed = F.array_compact(F.array(*checks))
    consistent = F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda a, x: a + x) / F.size(listed)).otherwise(0.5)
    notes = [id_note, *[F.when(high[e], F.lit(f"{e}: too high")) for e in elements], F.when(checks[0] == 0, F.lit("unknown method")), F.when(checks[1] == 0.5, F.lit("unknown mineral")), F.when(checks[2] == 0, F.lit("unusual year"))]
    out = agg.select(
        *keys, "rows", meta.alias("metadata"), complete.alias("elements"), id_score.alias("ids"), plausible.alias("plausibility"), consistent.alias("consistency"), F.array_join(F.array_compact(F.array(*notes)), "; ").alias("issues")
    )
    parts = ["metadata", "elements", "ids", "plausibility", "consistency"]
    whole = sum(w * F.col(p) for w, p in zip(QUALITY_WEIGHTS, parts))
    return out.select(*keys, "rows", *[F.round(100 * F.col(p), 2).alias(p) for p in parts], F.round(100 * whole, 2).alias("quality"), "issues")


def is_data_table(tables: DataFrame, keys: list[str], least: int = 3, first: int = 10, numbers: int = 5) -> DataFrame:
    """``(keys, is_data)`` of ``tables(keys, row_no, cells)``: at least ``least`` rows and columns and ``numbers`` numeric cells in the first rows."""
    numeric = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c).rlike(r"^[<>]?\s*[-+]?[0-9][0-9.,]*(?:[eE][-+]?[0-9]+)?$"), F.lit(False))))
    agg = tables.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"), F.max(F.size("cells")).alias("c"), F.sum(F.when(F.col("row_no") < first, numeric).otherwise(0)).alias("n"))
    return agg.select(*keys, ((F.col("r") >= least) & (F.col("c") >= least) & (F.col("n") >= numbers)).alias("is_data"))


#: Words of tables that hold summaries instead of samples, and openings of what is no sample name.
SUMMARY_WORDS = ["summary", "mean", "median", "average", "quantile", "std dev", "min-max", "range"]
NO_SAMPLE_NAME = (
    r"(?i)^\s*(note[s:]|d\.l\.?\s*$|b\.?d\.?l\.?\s*=|concentrations?\s+in\b|- not\b|numbers?\s+after|\*\s*calculated|"
    r"mean|average|std|median|min$|max$|minima|maxima|detection limit|all\s+values?\s+in\b)"
)


def is_summary_table(caption: Column, first_cells: Column, look: int = 5) -> Column:
    """A caption that says 'summary', or one of the first five cells of the first column that speaks of one."""
    says = lambda t: F.exists(F.array(*map(F.lit, SUMMARY_WORDS)), lambda w: F.contains(F.lower(F.coalesce(t, F.lit(""))), w))
    return F.contains(F.lower(F.coalesce(caption, F.lit(""))), F.lit("summary")) | F.exists(F.slice(first_cells, 1, look), says)


def is_sample_name(name: Column) -> Column:
    """Not blank, at most 100 characters, and no note or summary."""
    return F.coalesce((F.trim(name) != "") & (F.length(name) <= 100) & ~name.rlike(NO_SAMPLE_NAME), F.lit(False))


def id_list(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(id)``: the distinct sample names of the first of the columns that has any."""
    names = F.array(*[F.struct(F.lit(i).alias("c"), F.trim(F.col(c).cast("string")).alias("id")) for i, c in enumerate(columns)])
    each = rows.select(F.explode(names).alias("x")).select("x.*").where(is_sample_name(F.col("id"))).distinct()
    first = each.agg(F.min("c").alias("_first"))
    return each.join(F.broadcast(first), F.col("c") == F.col("_first"), "left_semi").select("id")  # one row


def corrected_cell(cell: Column) -> Column:
    """A cell of a truth table put right: numbers as doubles, below detection as -99999 or minus its limit, not analysed as null, and
    other text as it stands: ``struct<value, text, kind>``."""
    t = F.lower(F.trim(cell))
    limit = F.regexp_extract(t, r"^<\s*([0-9]*\.?[0-9]+)$", 1).try_cast("double")
    number = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    kind = F.when(cell.isNull() | (t == "") | t.isin(*NOT_ANALYSED_WORDS), "none").when(t.isin(*BELOW_WORDS), "bdl").when(limit > 0, "limit").when(number.isNotNull(), "number").otherwise("text")
    value = F.when(kind == "bdl", BELOW_DETECTION).when(kind == "limit", -limit).when(kind == "number", number)
    return F.struct(value.alias("value"), F.when(kind == "text", cell).alias("text"), kind.alias("kind"))


def base_sample_id(local_id: Column) -> Column:
    """The sample a spot's id belongs to: what stands before '@' or '-spot'."""
    return F.substring_index(F.substring_index(local_id, "@", 1), "-spot", 1)


def registry_state(documents: DataFrame, done: DataFrame, key: str, needs: list[str]) -> DataFrame:
    """``documents`` with ``state``: 'done', 'ready' (everything needed is there) or 'incomplete'. Null keys are never done."""
    d = done.select(F.col(key).alias("_k"), F.lit(True).alias("_done")).distinct()
    ready = F.lit(True)
    for c in needs:
        ready = ready & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return documents.join(d, F.col(key) == F.col("_k"), "left").withColumn("state", F.when(F.col("_done").isNotNull(), "done").when(ready, "ready").otherwise("incomplete")).drop("_k", "_done")


def find_document(documents: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``(wanted, key)``: the document of that exact name, else the first in order whose name contains it, any case; the names asked for are a small list."""
    from lodestrata.session import small_list

    w = small_list(wanted.select(F.col(wanted.columns[0]).alias("wanted")).where("wanted IS NOT NULL").distinct(), 1_000, "names")
    met = documents.select(key).distinct().join(w, F.contains(F.lower(key), F.lower("wanted")))
    return met.groupBy("wanted").agg(F.min(F.struct((F.col(key) != F.col("wanted")).alias("far"), F.col(key).alias("k")))["k"].alias(key))


def distinct_in_order(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``(keys, values, n)``: the distinct non-null values of each key in the order they first appear."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
    lists = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda x: x["v"]).alias("values"), F.size("l").alias("n"))


def state_counts(df: DataFrame, by: str) -> DataFrame:
    """``(state, n)`` with a total row, state null."""
    return df.rollup(F.col(by).alias("state")).agg(F.count(F.lit(1)).alias("n"))

