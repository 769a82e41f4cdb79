"""Queries of the sheet chain: grids are written from the golden sheet, one sheet a document, and read back into measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import shaping, sheets
from lodestrata.session import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ELS = ["zn", "fe", "cd", "ge"]
#: In every third document the sample column is empty, and the id stands in the column of analyses.
_BARE = "length(doc_id) > 0 AND ascii(right(doc_id, 1)) % 3 = 0"
_ROWS = (
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_id, last_update, analysis_id, sample_name) AS n, "
    f"CASE WHEN {_BARE} THEN NULL ELSE nullif(trim(sample_name, ' '), '') END AS sample, nullif(trim(analysis_id, ' '), '') AS analysis, nullif(trim(deposit_name, ' '), '') AS deposit, nullif(trim(mineral, ' '), '') AS mineral, "
    + ", ".join(f"CAST(CAST(round({e}_ppm, 3) AS DECIMAL(18, 3)) AS VARCHAR) AS {e}" for e in _ELS) + " FROM golden_sheet WHERE doc_id IS NOT NULL"
)


def _rows(s: SparkSession, d: str) -> DataFrame:
    g = read(s, d, "golden_sheet").where("doc_id IS NOT NULL")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_id", "last_update", "analysis_id", "sample_name"))
    bare = F.ascii(F.right("doc_id", F.lit(1))) % 3 == 0
    return g.select("doc_id", n.alias("n"), F.when(~bare, text("sample_name")).alias("sample"), text("analysis_id").alias("analysis"), text("deposit_name").alias("deposit"), text("mineral").alias("mineral"), *[F.round(f"{e}_ppm", 3).cast("decimal(18,3)").cast("string").alias(e) for e in _ELS])


def _grid(s: SparkSession, d: str) -> DataFrame:
    """A title, a header, a row of units and the rows; units stand in a header, in the row of units, or nowhere."""
    rows = _rows(s, d)
    body = rows.select(F.col("doc_id").alias("source_id"), F.lit("s").alias("sheet"), (F.col("n") + 2).cast("int").alias("row_idx"), F.array("sample", "analysis", "deposit", "mineral", *_ELS).alias("cells"))
    docs = rows.select("doc_id").distinct()
    line = lambda i, cells: docs.select(F.col("doc_id").alias("source_id"), F.lit("s").alias("sheet"), F.lit(i).alias("row_idx"), F.array(*[F.lit(c).cast("string") for c in cells]).alias("cells"))
    return (
        line(0, ["Supplement", None, None, None, None, None, None, None])
        .unionByName(line(1, ["Sample No.", "Analysis ID", "Deposit", "Mineral", "Zn (ppm)", "Fe wt%", "Cd", "Ge"]))
        .unionByName(line(2, [None, None, None, None, "ppm", "wt%", "ppb", "ppm"])).unionByName(body)
    )


def _chain(s: SparkSession, d: str):
    cells = sheets.filled_cells(_grid(s, d))
    heads = sheets.header_row(cells)
    return cells, heads, sheets.column_profile(cells, heads)


_IDS = (
    f"WITH r AS ({_ROWS}), p AS (SELECT doc_id, count(sample) / (count(*) + 1) AS cov, count(analysis) / (count(*) + 1) AS acov, count(DISTINCT analysis) / greatest(count(analysis), 1) AS auniq, "
    "count(*) FILTER (regexp_matches(replace(lower(analysis), ',', ''), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) / greatest(count(analysis), 1) AS anum FROM r GROUP BY 1), "
    "c AS (SELECT doc_id, CASE WHEN cov >= 0.3 THEN 0 WHEN acov >= 0.5 AND auniq > 0.5 AND anum <= 0.8 THEN 1 ELSE 0 END AS sample_col FROM p)"
)


@query(f"{_IDS} SELECT doc_id AS source_id, 'sample' AS role, sample_col AS col_idx FROM c UNION ALL SELECT doc_id, role, i FROM c, (VALUES ('deposit', 2), ('mineral', 3), ('element', 4), ('element', 5), ('element', 6), ('element', 7)) v(role, i)")
def role_detect(s, d):
    _, _, profile = _chain(s, d)
    return sheets.column_roles(profile).select("source_id", "role", "col_idx")


@query("SELECT DISTINCT doc_id AS source_id, 1 AS header_row, 4 AS symbols FROM golden_sheet WHERE doc_id IS NOT NULL")
def header_detect(s, d):
    cells = sheets.filled_cells(_grid(s, d))
    return sheets.header_row(cells).select("source_id", "header_row", F.col("symbols").cast("int").alias("symbols"))


@query("SELECT doc_id AS source_id, symbol, unit FROM (SELECT DISTINCT doc_id FROM golden_sheet WHERE doc_id IS NOT NULL), (VALUES ('zn', 'ppm'), ('fe', 'wt%'), ('cd', 'ppb'), ('ge', 'ppm')) v(symbol, unit)")
def unit_detect(s, d):
    cells, heads, profile = _chain(s, d)
    return sheets.column_units(cells, heads, profile, sheets.unit_rows_of(cells, heads)).select("source_id", "symbol", "unit")


def _sample_filter(c: str) -> str:
    t = f"trim({c}, ' ')"
    return (
        f"NOT ({c} IS NULL OR {t} = '' OR length({t}) > 80 OR (suffix({t}, '.') AND contains({t}, ' ') AND length({t}) > 30) OR regexp_matches({t}, '^(Note:|note:|\\*|†|‡|§)') "
        f"OR regexp_matches({c}, '{shaping.SUMMARY_ROW}') OR regexp_matches({c}, '{shaping.SUMMARY_INSIDE}') OR regexp_matches({c}, '{shaping.REFERENCE_STANDARD}'))"
    )


@query(
    f"{_IDS}, f AS (SELECT r.doc_id, n, CASE WHEN sample_col = 0 THEN sample ELSE analysis END AS sid, deposit, mineral, zn, fe, cd, ge, count(*) OVER w AS rows, count(CASE WHEN sample_col = 0 THEN sample ELSE analysis END) OVER w AS has, count(*) FILTER (n <= 20 AND coalesce(zn, fe, cd, ge) IS NOT NULL) OVER w AS busy FROM r JOIN c USING (doc_id) "
    "WHERE coalesce(sample, analysis, deposit, mineral, zn, fe, cd, ge) IS NOT NULL WINDOW w AS (PARTITION BY r.doc_id)), "
    "g AS (SELECT *, CASE WHEN has < 0.5 * rows AND has >= 2 AND busy >= 10 THEN last_value(sid IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE sid END AS sample FROM f), "
    f"k AS (SELECT * FROM g WHERE {_sample_filter('sample')}), "
    "v AS (SELECT doc_id, n, sample, 'zn' AS element, zn AS cell, 1.0::DOUBLE AS k FROM k UNION ALL SELECT doc_id, n, sample, 'fe', fe, 10000 FROM k UNION ALL SELECT doc_id, n, sample, 'cd', cd, 0.001 FROM k UNION ALL SELECT doc_id, n, sample, 'ge', ge, 1 FROM k) "
    "SELECT doc_id AS source_id, (n + 2)::INT AS row_idx, sample, element, round(cell::DOUBLE * k, 6) AS value FROM v WHERE cell IS NOT NULL"
)
def single_sheet(s, d):
    m = sheets.sheet_measurements(_grid(s, d))
    return m.select("source_id", "row_idx", "sample", "element", F.round("value", 6).alias("value"))


def _sideways(s: SparkSession, d: str) -> DataFrame:
    """Greatest values of the elements by mineral with the elements as rows, and the same upright, of each document."""
    g = read(s, d, "golden_sheet").where("doc_id IS NOT NULL AND mineral IS NOT NULL")
    els = [*_ELS, "ag"]
    means = g.groupBy("doc_id", "mineral").agg(*[F.floor(F.max(F.when(F.col(f"{e}_ppm") >= 0, F.col(f"{e}_ppm")))).cast("string").alias(e) for e in _ELS]).withColumn("ag", F.lit("1.00"))
    listed = means.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mineral", *els))).alias("l"))
    lying = [F.struct(F.lit(i).alias("row_idx"), F.concat(F.array(F.lit(head)), F.col(f"l.{c}")).alias("cells")) for i, (head, c) in enumerate([("Sample", "mineral"), *[(e.capitalize(), e) for e in els]])]
    a = listed.select(F.col("doc_id").alias("source_id"), F.lit("lying").alias("sheet"), F.explode(F.array(*lying)).alias("x")).select("source_id", "sheet", "x.*")
    head = listed.select(F.col("doc_id").alias("source_id"), F.lit("upright").alias("sheet"), F.lit(0).alias("row_idx"), F.array(F.lit("Sample"), *[F.lit(e.capitalize()) for e in els]).alias("cells"))
    body = listed.select("doc_id", F.posexplode("l").alias("i", "x")).select(F.col("doc_id").alias("source_id"), F.lit("upright").alias("sheet"), (F.col("i") + 1).alias("row_idx"), F.array("x.mineral", *[f"x.{e}" for e in els]).alias("cells"))
    return a.unionByName(head).unionByName(body)


@query("SELECT doc_id AS source_id, sheet, sheet = 'lying' AS transposed FROM (SELECT DISTINCT doc_id FROM golden_sheet WHERE doc_id IS NOT NULL AND mineral IS NOT NULL), (VALUES ('lying'), ('upright')) v(sheet)")
def transposed_detect(s, d):
    cells = sheets.filled_cells(_sideways(s, d))
    return sheets.orientation(cells, sheets.header_row(cells)).select("source_id", "sheet", "transposed")


@query(
    "WITH m AS (SELECT doc_id, mineral, " + ", ".join(f"floor(max({e}_ppm) FILTER ({e}_ppm >= 0)) AS {e}" for e in _ELS) + " FROM golden_sheet WHERE doc_id IS NOT NULL AND mineral IS NOT NULL GROUP BY ALL), "
    "t AS (" + " UNION ALL ".join(f"SELECT doc_id, mineral, '{e}' AS element, {e}::DOUBLE AS value FROM m WHERE {e} IS NOT NULL" for e in _ELS) + " UNION ALL SELECT doc_id, mineral, 'ag', 1 FROM m) "
    f"SELECT doc_id AS source_id, mineral AS sample, element, value, 2 AS sheets FROM t WHERE {_sample_filter('mineral')}"
)
def transposed_sheets(s, d):
    """Each value comes out of the sheet that lies and of the one that stands."""
    m = sheets.sheet_measurements(_sideways(s, d))
    return m.groupBy("source_id", "sample", "element", F.round("value", 2).alias("value")).agg(F.count_distinct("sheet").cast("int").alias("sheets"))
