"""From a raw sheet to typed measurements: orientation, header, column roles, units, ids, sample rows, censored cells.

A grid is ``(source_id, sheet, row_idx, cells ARRAY<STRING>)``, any number of sheets at once. What is decided for a sheet (its header
row, the role and the unit of each column) is a small table beside the grid, made by aggregates over its cells, so every step is one
plan over all sheets. ``hints(source_id, header_row, sample_column, unit, transposed)`` overrides what is inferred, where given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import censored
from lodestrata.functions.elements import header_symbol
from lodestrata.operators.enrichment import source_tag
from lodestrata.operators.shaping import UNIT_TOKENS, is_sample_row
from lodestrata.session import checkpointed

SHEET = ["source_id", "sheet"]
#: Headers that give a column its role, any case; of several columns the first in the sheet has it.
ROLE_HEADERS = {
    "sample": [
        "sample", "sample_id", "sample id", "sample name", "sample no", "sample no.", "sample number", "spot", "spot_id", "spot id", "spot no", "spot no.", "spot name", "analysis", "analysis_id", "analysis id",
        "analysis no", "analysis no.", "analysis number", "analythical spot", "analytical spot", "dot id", "dot_id", "dot no", "dot no.", "id", "label", "name", "point", "grain", "number", "no", "no.",
    ],
    "deposit": ["ore deposit", "deposit", "mine", "location", "area", "district", "ore diposit"],
    "reference": ["reference", "ref", "source", "citation", "data source"],
    "mineral": ["mineral", "mineral1", "mineral_phase", "phase", "mineral phase", "mineral name", "mineralogy", "min", "analyzed mineral"],
    "method": ["method", "analytical method", "technique", "analysis method", "analytical technique", "analysis", "analysis_method"],
    "zone": ["zone", "type", "texture", "crystal zone", "spot type", "grain type", "generation"],
    "spot": ["spot", "spot no", "spot no.", "point", "point no", "point no.", "analysis no", "analysis no."],
}
#: Headers that name no sample though unique, labels of transposed sheets, words of units and of a microprobe.
NO_SAMPLE = ["µg/g", "ug/g", "μg/g", "ppm", "ppb", "wt%", "wt %", "mg/kg", "g/t", "%", "mean", "2se", "2sd", "sd", "se", "detection limit", "lod", "dl"]
ROW_LABELS = {"spot_id": "spot id", "ts_id": "sample", "ts id": "sample", "sample_id": "sample", "sample": "sample", "zone": "zone", "mineral": "mineral", "mineral1": "mineral", "generation": "zone"}
PERCENT_WORDS = ["wt%", "wt %", "wt.%", "(wt%)", "(wt.%)", "(%)", "mass%", "(mass%)"]
PPM_WORDS = ["ppm", "µg/g", "ug/g", "μg/g", "mg/kg", "g/t"]
PPB_WORDS = ["ppb", "ng/g"]
PROBE_WORDS = ["empa", "epma", "electron microprobe", "electron probe"]
PPM_FACTOR = {"wt%": 1e4, "ppm": 1.0, "ppb": 1e-3}


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _has(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def filled_cells(grid: DataFrame) -> DataFrame:
    """``(source_id, sheet, row_idx, col_idx, cell)`` of the filled cells, trimmed. Empty rows and columns leave nothing."""
    cells = grid.select(*SHEET, "row_idx", F.posexplode("cells").alias("col_idx", "cell"))
    return cells.withColumn("cell", _text(F.col("cell"))).where("cell IS NOT NULL")


def without_numbered_header(grid: DataFrame) -> DataFrame:
    """Sheets whose first row only numbers the columns lose it; the next row is their header."""
    w = Window.partitionBy(*SHEET)
    named = F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    numbered = (F.size(named) > 0) & F.forall(named, lambda c: F.trim(c).rlike(r"^[0-9]+$"))
    return grid.withColumn("_first", F.min("row_idx").over(w)).where(~((F.col("row_idx") == F.col("_first")) & numbered)).drop("_first")


def header_row(cells: DataFrame, hints: DataFrame | None = None, first: int = 20, least: int = 2) -> DataFrame:
    """``(source_id, sheet, header_row, symbols)``, a row for every sheet: of its first rows the one with most element symbols, the
    earliest on ties, else its first row. Rows of three filled cells or fewer in a sheet wider than five don't count."""
    width = cells.groupBy(*SHEET).agg((F.max("col_idx") + 1).alias("width"), F.min("row_idx").alias("top"))
    rows = cells.where(F.col("row_idx") < first).groupBy(*SHEET, "row_idx").agg(F.count(F.lit(1)).alias("filled"), F.count(header_symbol(F.col("cell"))).alias("symbols"))
    ok = rows.join(width, SHEET).where(((F.col("width") <= 5) | (F.col("filled") > 3)) & (F.col("symbols") >= least))
    best = ok.groupBy(*SHEET).agg(F.max(F.struct("symbols", (-F.col("row_idx")).alias("r"))).alias("b"))
    out = width.join(best, SHEET, "left").select(*SHEET, F.coalesce(-F.col("b.r"), "top").alias("header_row"), F.coalesce("b.symbols", F.lit(0)).alias("symbols"))
    if hints is None:
        return out
    told = hints.select("source_id", F.col("header_row").alias("_h"))
    return out.join(told, "source_id", "left").select(*SHEET, F.coalesce("_h", "header_row").alias("header_row"), "symbols")


def orientation(cells: DataFrame, heads: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(source_id, sheet, header_row, transposed, label_col)``: a sheet lies on its side if its header has fewer than three element
    symbols and one of its first three columns five or more, making up 30 % of that column; the first such column holds the labels."""
    body = cells.join(heads, SHEET).where("row_idx > header_row AND col_idx < 3")
    columns = body.groupBy(*SHEET, "col_idx").agg(F.count(header_symbol(F.col("cell"))).alias("n"), F.count(F.lit(1)).alias("all"))
    labels = columns.where("n >= 5 AND n >= 0.3 * all").groupBy(*SHEET).agg(F.min("col_idx").alias("label_col"))
    top = cells.join(heads, SHEET).where("row_idx = header_row").groupBy(*SHEET).agg(F.count(header_symbol(F.col("cell"))).alias("named"))
    out = heads.join(labels, SHEET, "left").join(top, SHEET, "left")
    lies = F.col("label_col").isNotNull() & (F.coalesce("named", F.lit(0)) < 3)
    if hints is not None:
        out = out.join(hints.select("source_id", F.col("transposed").alias("_t")), "source_id", "left")
        lies = F.coalesce("_t", lies)
    return out.select(*SHEET, "header_row", lies.alias("transposed"), F.coalesce("label_col", F.lit(0)).alias("label_col"))


def upright(cells: DataFrame, turned: DataFrame) -> DataFrame:
    """Cells with transposed sheets set upright: each label a column, each later column a row, the header the sample ids.

    Columns before the labels and one that holds detection limits go. A label row that only names a percent unit holds for the
    elements below it. The header of a turned sheet is row 0. Sheets that stand keep their cells.
    """
    marked = cells.join(turned.where("transposed"), SHEET)
    limits = marked.where(F.lower("cell").contains("detection limit") & (F.col("row_idx") <= F.col("header_row") + 8)).select(*SHEET, F.col("col_idx").alias("_c")).distinct()
    names = marked.where("col_idx = label_col AND row_idx >= header_row").select(*SHEET, "row_idx", F.lower("cell").alias("label"), (F.col("row_idx") == F.col("header_row")).alias("head"))
    unit = F.col("label").isin("wt%", "wt.%", "(wt%)", "(wt.%)", "%")
    above = F.max(unit.cast("int")).over(Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)) == 1
    known = F.create_map(*[F.lit(x) for kv in ROW_LABELS.items() for x in kv])
    name = F.when(F.col("head"), F.when(F.col("label").rlike("spot|sample|analysis|id"), "spot id").otherwise(F.col("label"))).when(
        header_symbol(F.col("label")).isNotNull() & above & ~_has(F.col("label"), PERCENT_WORDS), F.concat("label", F.lit(" wt%"))
    ).otherwise(F.coalesce(F.try_element_at(known, "label"), "label"))
    names = names.withColumn("name", name).where(~unit).drop("label", "head")
    data = marked.where("col_idx > label_col AND row_idx >= header_row").join(limits, (F.col("col_idx") == F.col("_c")) & (marked["source_id"] == limits["source_id"]) & (marked["sheet"] == limits["sheet"]), "left_anti")
    body = data.join(names.select(*SHEET, "row_idx"), [*SHEET, "row_idx"]).select(*SHEET, F.col("col_idx").alias("row_idx"), (F.col("row_idx") - F.col("header_row")).alias("col_idx"), "cell")
    heads = names.join(turned.select(*SHEET, "header_row"), SHEET).select(*SHEET, F.lit(0).alias("row_idx"), (F.col("row_idx") - F.col("header_row")).alias("col_idx"), F.col("name").alias("cell"))
    stands = cells.join(turned.where("NOT transposed").select(*SHEET), SHEET)
    return stands.unionByName(heads).unionByName(body)


def column_profile(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """``(source_id, sheet, col_idx, raw_name, symbol, coverage, uniqueness, numeric_share)`` of the columns below the header."""
    joined = cells.join(heads.select(*SHEET, "header_row"), SHEET)
    names = joined.where("row_idx = header_row").select(*SHEET, "col_idx", F.col("cell").alias("raw_name"))
    body = joined.where("row_idx > header_row")
    rows = body.groupBy(*SHEET).agg(F.count_distinct("row_idx").alias("rows"))
    number = censored.parse_cell(F.col("cell"))["status"].isNotNull()
    stats = body.groupBy(*SHEET, "col_idx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell").alias("u"), F.count_if(number).alias("m"))
    p = names.join(stats, [*SHEET, "col_idx"], "left").join(rows, SHEET, "left")
    share = lambda a, b: F.coalesce(F.col(a), F.lit(0)) / F.greatest(F.coalesce(F.col(b), F.lit(1)), F.lit(1))
    return p.select(*SHEET, "col_idx", "raw_name", header_symbol(F.col("raw_name")).alias("symbol"), share("n", "rows").alias("coverage"), share("u", "n").alias("uniqueness"), share("m", "n").alias("numeric_share"))


def column_roles(profile: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(source_id, sheet, role, col_idx, raw_name)``: at most one column a role, and role 'element' for every element column.

    The sample column is the first with such a header if 30 % of its rows are filled; else a later one that is half filled, half
    unique and no number, else that first one; without any such header one of the first five that is mostly unique and neither a
    unit nor an element; else the first column. The spot column is mostly numeric and not the sample column.
    """
    low = F.lower(F.trim("raw_name"))
    listed = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.array(*map(F.lit, names)).alias("names")) for role, names in ROLE_HEADERS.items() if role not in ("sample", "spot")]))
    others = profile.select("*", listed.alias("r")).where(F.array_contains("r.names", low)).groupBy(*SHEET, F.col("r.role").alias("role")).agg(F.min("col_idx").alias("col_idx"))

    named = low.isin(*ROLE_HEADERS["sample"])
    first = F.min(F.when(named, F.struct("col_idx", "coverage")))
    text = F.min(F.when(named & (F.col("coverage") >= 0.5) & (F.col("numeric_share") <= 0.8) & (F.col("uniqueness") > 0.5), F.col("col_idx")))
    unique = F.min(F.when((F.col("col_idx") < 5) & ~low.isin(*NO_SAMPLE) & F.col("symbol").isNull() & (F.col("uniqueness") > 0.7) & (F.col("coverage") > 0), F.col("col_idx")))
    chosen = profile.groupBy(*SHEET).agg(first.alias("f"), text.alias("t"), unique.alias("u"), F.min("col_idx").alias("least"))
    column = F.when(F.col("f").isNull(), F.coalesce("u", "least")).when((F.col("f.coverage") >= 0.3) | F.col("t").isNull(), F.col("f.col_idx")).otherwise(F.col("t"))
    sample = chosen.select(*SHEET, column.alias("col_idx"))
    if hints is not None:
        wanted = profile.join(hints.select("source_id", "sample_column"), "source_id").where(low == F.lower(F.trim("sample_column"))).groupBy(*SHEET).agg(F.min("col_idx").alias("_h"))
        sample = sample.join(wanted, SHEET, "left").select(*SHEET, F.coalesce("_h", "col_idx").alias("col_idx"))

    spot = profile.where(low.isin(*ROLE_HEADERS["spot"]) & (F.col("numeric_share") >= 0.5) & (F.col("coverage") > 0))
    spot = spot.join(sample.select(*SHEET, F.col("col_idx").alias("_s")), SHEET).where("col_idx != _s").groupBy(*SHEET).agg(F.min("col_idx").alias("col_idx"))
    with_role = lambda df, role: df.select(*SHEET, F.lit(role).alias("role"), "col_idx")
    roles = others.select(*SHEET, "role", "col_idx").unionByName(with_role(sample, "sample")).unionByName(with_role(spot, "spot")).unionByName(with_role(profile.where("symbol IS NOT NULL"), "element"))
    return roles.join(profile.select(*SHEET, "col_idx", "raw_name"), [*SHEET, "col_idx"], "left").select(*SHEET, "role", "col_idx", "raw_name")


def unit_rows_of(cells: DataFrame, heads: DataFrame, within: int = 3) -> DataFrame:
    """``(source_id, sheet, row_idx)`` of the rows just below the header that only name units: two or more, 30 % of the filled cells."""
    near = cells.join(heads.select(*SHEET, "header_row"), SHEET).where(f"row_idx > header_row AND row_idx <= header_row + {within}")
    agg = near.groupBy(*SHEET, "row_idx").agg(F.count_if(F.lower("cell").isin(*UNIT_TOKENS, "wt %")).alias("units"), F.count(F.lit(1)).alias("filled"))
    return agg.where("units >= 2 AND units >= 0.3 * filled").groupBy(*SHEET).agg(F.min("row_idx").alias("row_idx"))


def column_units(cells: DataFrame, heads: DataFrame, profile: DataFrame, unit_rows: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(source_id, sheet, col_idx, symbol, unit)`` of the element columns: 'wt%', 'ppm' or 'ppb'.

    A column's unit stands in its header, in a row of units below it or in its column above it. A sheet without any such column is
    in percent where the text above the header says so, or names a microprobe and no other unit; then the columns whose median
    lies from 0.01 to 100 are percents. All else is ppm.
    """
    e = profile.where("symbol IS NOT NULL").select(*SHEET, "col_idx", "symbol", F.lower("raw_name").alias("head"))
    joined = cells.join(heads.select(*SHEET, "header_row"), SHEET)
    above = joined.where("row_idx < header_row").select(*SHEET, "col_idx", F.lower("cell").alias("u"))
    under = joined.join(unit_rows, [*SHEET, "row_idx"], "left_semi").select(*SHEET, "col_idx", F.lower("cell").alias("u"))
    # above a header a title may stand in a column by chance: only cells that are a unit count
    told = above.where(F.col("u").isin(*UNIT_TOKENS, "wt %")).unionByName(under).groupBy(*SHEET, "col_idx").agg(F.concat_ws(" ", F.collect_set("u")).alias("told"))
    e = e.join(told, [*SHEET, "col_idx"], "left")
    said = F.concat_ws(" ", "head", "told")
    own = F.when(_has(said, PPB_WORDS), "ppb").when(_has(said, PERCENT_WORDS) | F.coalesce(F.trim("told") == "%", F.lit(False)), "wt%").when(_has(said, PPM_WORDS), "ppm")
    title = above.groupBy(*SHEET).agg(F.concat_ws(" ", F.collect_list("u")).alias("title"))
    t = F.coalesce("title", F.lit(""))
    e = e.withColumn("own", own).join(title, SHEET, "left")
    sheet = e.groupBy(*SHEET).agg(
        F.count_if(F.col("own") == "wt%").alias("wt"), F.count_if(F.col("own").isin("ppm", "ppb")).alias("pp"), F.first(_has(t, PERCENT_WORDS)).alias("says_wt"), F.first(_has(t, [*PPM_WORDS, *PPB_WORDS])).alias("says_pp"), F.first(_has(t, PROBE_WORDS)).alias("probe")
    )
    percent = (F.col("wt") == 0) & (F.col("pp") == 0) & ~F.col("says_pp") & (F.col("says_wt") | F.col("probe"))
    if hints is not None:
        sheet = sheet.join(hints.select("source_id", F.col("unit").alias("_u")), "source_id", "left")
        percent = F.when(F.col("_u").isNotNull(), F.col("_u") == "wt%").otherwise(percent)
    real = censored.parse_cell(F.col("cell"))["value"]
    medians = joined.where("row_idx > header_row").join(e.select(*SHEET, "col_idx"), [*SHEET, "col_idx"], "left_semi").groupBy(*SHEET, "col_idx").agg(F.median(F.when(real >= 0, real)).alias("median"), F.count(F.when(real >= 0, real)).alias("reals"))
    out = e.join(sheet.select(*SHEET, percent.alias("percent")), SHEET).join(medians, [*SHEET, "col_idx"], "left")
    guess = F.when(F.col("percent") & (F.col("reals") >= 2) & F.col("median").between(0.01, 100), "wt%").otherwise("ppm")
    return out.select(*SHEET, "col_idx", "symbol", F.coalesce("own", guess).alias("unit"))


def sheet_samples(cells: DataFrame, heads: DataFrame, roles: DataFrame, unit_rows: DataFrame, deposit: str | None = None) -> DataFrame:
    """``(source_id, sheet, row_idx, sample, deposit, reference, mineral, method, zone, spot, tag)`` of the rows that are samples.

    A sparse sample column (under half filled, twice or more, in a sheet of which ten of the first 20 rows have values) is filled
    down. Summaries, standards, notes and rows without an id go; rows that cite a source stay, tagged. With ``deposit`` only the
    sheet's rows of that deposit stay, if there are any and not all are.
    """
    body = cells.join(heads.select(*SHEET, "header_row"), SHEET).where("row_idx > header_row").join(unit_rows, [*SHEET, "row_idx"], "left_anti")
    typed = body.join(roles.select(*SHEET, "col_idx", "role"), [*SHEET, "col_idx"])
    names = ["sample", "deposit", "reference", "mineral", "method", "zone", "spot"]
    wide = typed.groupBy(*SHEET, "row_idx").agg(*[F.min(F.when(F.col("role") == r, F.col("cell"))).alias(r) for r in names], F.count_if(F.col("role") == "element").alias("_e"))
    w = Window.partitionBy(*SHEET)
    ordered = w.orderBy("row_idx")
    n, has = F.count(F.lit(1)).over(w), F.count("sample").over(w)
    wide = wide.withColumn("_n", F.row_number().over(ordered)).withColumn("_busy", F.count_if((F.col("_n") <= 20) & (F.col("_e") > 0)).over(w))
    sparse = (has < 0.5 * n) & (has >= 2) & (F.col("_busy") >= 10)
    above = F.last("sample", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rows = wide.withColumn("sample", F.when(sparse, above).otherwise(F.col("sample"))).where(is_sample_row(F.col("sample")))
    if deposit is not None:
        same = F.coalesce(F.contains(F.lower("deposit"), F.lit(deposit.lower())), F.lit(False))
        k, all_ = F.count_if(same).over(w), F.count(F.lit(1)).over(w)
        rows = rows.withColumn("_same", same).withColumn("_apply", (k > 0) & (k < all_)).where(~F.col("_apply") | F.col("_same")).drop("_same", "_apply")
    tag = source_tag(*[F.coalesce(c, F.lit("")) for c in ("sample", "deposit", "zone")])
    cited = F.when(F.col("reference").isNotNull() & ~F.lower("reference").isin("this study", "this_study", "this work"), F.concat(F.lit("cited_study:"), F.substring("reference", 1, 50)))
    return rows.select(*SHEET, "row_idx", *names, F.coalesce(cited, tag).alias("tag"))


def sheet_measurements(grid: DataFrame, hints: DataFrame | None = None, deposit: str | None = None) -> DataFrame:
    """``(source_id, sheet, row_idx, sample, deposit, mineral, method, zone, spot, tag, element, status, value, lod, original_value, original_unit)``.

    The whole chain over all sheets: numbered headers dropped, sheets set upright, roles and units found, ids filled, sample rows
    kept, cells parsed and brought to ppm (values and known limits alike). Of two columns of one element the first with a filled
    cell counts. Empty grids give nothing; sheets without an element column neither.
    """
    cells = checkpointed(filled_cells(without_numbered_header(grid)))  # every decision reads the cells again
    turned = checkpointed(orientation(cells, header_row(cells, hints), hints))
    if not turned.where("transposed").isEmpty():
        cells = checkpointed(upright(cells, turned))
    heads = turned.select(*SHEET, F.when(F.col("transposed"), 0).otherwise(F.col("header_row")).alias("header_row"))
    profile = checkpointed(column_profile(cells, heads))
    unit_rows = unit_rows_of(cells, heads)
    roles = column_roles(profile, hints)
    units = column_units(cells, heads, profile, unit_rows, hints)
    samples = sheet_samples(cells, heads, roles, unit_rows, deposit)
    values = cells.join(units, [*SHEET, "col_idx"]).join(samples, [*SHEET, "row_idx"])
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in PPM_FACTOR.items() for x in kv]), F.col("unit"))
    first = values.groupBy(*SHEET, "row_idx", F.col("symbol").alias("element")).agg(F.min(F.struct("col_idx", "cell", "unit", *[c for c in samples.columns if c not in (*SHEET, "row_idx")], factor.alias("factor"))).alias("x"))
    parsed = censored.convert(censored.parse_cell(F.col("x.cell")), F.col("x.factor"))
    out = first.withColumn("p", parsed).where("p.status IS NOT NULL")
    return out.select(*SHEET, "row_idx", *[f"x.{c}" for c in ("sample", "deposit", "mineral", "method", "zone", "spot", "tag")], "element", "p.status", "p.value", "p.lod", F.col("x.cell").alias("original_value"), F.col("x.unit").alias("original_unit"))


def merged_files(measurements: DataFrame, order: str = "source_id") -> DataFrame:
    """Measurements of several files as one table: of each (sample, element) the first file's, then the first row's, non-null value."""
    pick = F.min(F.struct(order, "sheet", "row_idx", "status", "value", "lod"))
    return measurements.groupBy("sample", "element").agg(pick.alias("m")).select("sample", "element", F.col(f"m.{order}").alias("source_id"), "m.status", "m.value", "m.lod")
