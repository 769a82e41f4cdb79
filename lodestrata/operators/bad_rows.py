"""Rows that fail to parse: set apart with a reason while the valid rows load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number columns of an appendix and the words that stand for "not measured" in them.
NUMBER_COLUMNS = ["Fe", "Zn", "Cu", "S", "Cd", "Mn", "Total"]
EMPTY_WORDS = ["", "-", "bdl", "n.d."]
DELIMITERS = [",", ";", "\t", "|"]


def _class(delim: str) -> str:
    return "\\t" if delim == "\t" else "\\" + delim if delim in "|^]\\" else delim


def quoting_is_sound(line: Column, delim: str) -> Column:
    """Every quote opens or closes a whole field or is doubled inside a quoted one. Possessive, so linear in the line."""
    d = _class(delim)
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    field = f'(?:{quoted}|[^"{d}]*+)'
    return line.rlike(rf"\A{field}(?:[{d}]{field})*+\z")


def split_fields(line: Column, delim: str) -> Column:
    """Field texts of a soundly quoted line: each field with the delimiter after it, then unquoted."""
    d = _class(delim)
    pattern = rf'("[^"]*+(?:""[^"]*+)*+"|[^"{d}]*+)[{d}]'
    raw = F.regexp_extract_all(F.concat(line, F.lit(delim)), F.lit(pattern), 1)
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda f: F.when(F.startswith(f, F.lit('"')), inner(f)).otherwise(f))


def classify_rows(
    lines: DataFrame,
    files: DataFrame,
    delimiters: list[str] | None = None,
    number_columns: list[str] | None = None,
    max_formats: int = 64,
) -> DataFrame:
    """Each data line with its cells and, if it is bad, the first reason that applies.

    ``lines`` needs (line_id, file_id, line_no, line), ``files`` the description of each file (delim, n_cols, columns,
    sample_id_col, first_line, last_line). Every line is read permissively under the explicit schema of its file's format
    (delimiter and column count), keeping the raw text of the lines the reader calls corrupt; those are reclassified by
    quoting, field count and cast checks. Quoting is checked on accepted lines too, as the reader forgives some of it.
    Returns ``(line_id, file_id, line_no, line, fields, parsed, reason)``: ``parsed`` holds the reader's cells and the corrupt
    text; ``reason`` is null for valid rows, else 'broken_quote', 'column_count' or 'invalid_value'. Null and blank lines and
    lines outside first_line..last_line are left out; a trailing carriage return is ignored. Lines of unknown files, and of
    files whose delimiter is not among ``delimiters``, get the reason 'unknown_format'. Beyond ``max_formats`` formats the
    lines of the others go through the checks alone, with the same result.
    """
    delimiters = delimiters or DELIMITERS
    number_columns = number_columns or NUMBER_COLUMNS
    spec = files.select("file_id", "delim", "n_cols", "columns", "sample_id_col", "first_line", "last_line")
    body = (
        lines.select("line_id", "file_id", "line_no", "line")
        .join(spec, "file_id", "left")
        .where(F.col("delim").isNull() | F.col("line_no").between(F.col("first_line"), F.col("last_line")))
        .withColumn("_l", F.regexp_replace("line", r"\r+\z", ""))
        .where(F.trim(F.regexp_replace("_l", r"[\s ]+", "")) != "")
    )
    formats = sorted(
        (r["delim"], r["n_cols"])
        for r in spec.where(F.col("delim").isin(*delimiters) & F.col("n_cols").between(1, 4096))
        .select("delim", "n_cols").distinct().orderBy("delim", "n_cols").limit(max_formats).collect()
    )

    def choose(cases) -> Column:
        return reduce(lambda c, x: c.when(*x), cases, F.when(F.lit(False), cases[0][1] if cases else F.lit(None)))

    def by_delim(make) -> Column:
        return choose([(F.col("delim") == d, make(d)) for d in delimiters])

    def reader(d: str, n: int) -> Column:
        """The permissive reader's row as (cells, corrupt raw text)."""
        schema = ", ".join(f"c{i} STRING" for i in range(n)) + ", _corrupt STRING"
        row = F.from_csv(
            F.col("_l"), schema,
            {"sep": d, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "maxCharsPerColumn": "-1", "inputBufferSize": "8192"},
        )
        return F.struct(
            F.array(*[F.coalesce(row[f"c{i}"], F.lit("")) for i in range(n)]).alias("cells"), row["_corrupt"].alias("corrupt")
        )

    none = F.lit(None).cast("struct<cells:array<string>,corrupt:string>")
    read_rows = [((F.col("delim") == d) & (F.col("n_cols") == n), reader(d, n)) for d, n in formats]
    sound = F.col("_sound")
    accepted = F.col("parsed").isNotNull() & F.col("parsed.corrupt").isNull()
    cells = (
        body.withColumn("parsed", choose(read_rows) if read_rows else none)
        .withColumn("_sound", by_delim(lambda d: quoting_is_sound(F.col("_l"), d)))
        .withColumn("fields", F.when(accepted & sound, F.col("parsed.cells")).when(sound, by_delim(lambda d: split_fields(F.col("_l"), d))))
    )
    at = F.col("fields")
    mark = F.when(F.col("delim") == ";", F.lit(",")).otherwise(F.lit("."))
    first_bad = ~F.coalesce(F.trim(at[0]).rlike(r"\A\+?0*[1-9][0-9]*\z"), F.lit(False))
    place = F.array_position("columns", F.col("sample_id_col")).cast("int")
    sample = F.when(place > 0, F.try_element_at(at, place))
    sample_bad = place.isNotNull() & (place > 0) & (
        (F.coalesce(F.regexp_replace(sample, r"[\s ]+", ""), F.lit("")) == "") | F.contains(sample, F.lit("�"))
    )

    def cell_bad(x: Column) -> Column:
        t = F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")
        number = F.when(mark == ",", t.rlike(r"\A(?:<\s*)?[-+]?[0-9]+(?:,[0-9]+)?(?:[eE][-+]?[0-9]+)?\z")).otherwise(
            t.rlike(r"\A(?:<\s*)?[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?\z")
        )
        return ~(t.isin(*EMPTY_WORDS) | number)

    pairs = F.arrays_zip(F.col("columns").alias("name"), at.alias("cell"))
    numbers_bad = F.exists(pairs, lambda p: p["name"].isin(*number_columns) & F.coalesce(cell_bad(p["cell"]), F.lit(False)))
    reason = (
        F.when(F.col("_sound").isNull(), "unknown_format")
        .when(~F.col("_sound"), "broken_quote")
        .when(F.size(at) != F.col("n_cols"), "column_count")
        .when(first_bad | sample_bad | numbers_bad, "invalid_value")
    )
    # a column that isn't deterministic keeps filters on the reason from being pushed to the scan with all parsing written out
    reason = F.when(F.spark_partition_id() >= 0, reason)
    return cells.withColumn("reason", reason).select("line_id", "file_id", "line_no", "line", "fields", "parsed", "reason")


def rejected_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(line_id, reason)`` of the lines that fail to load."""
    return classify_rows(lines, files).where(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded_cells(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The valid rows as ``(file_id, line_id, line_no, position, column, value)``, one row per cell."""
    good = classify_rows(lines, files).where(F.col("reason").isNull())
    named = good.join(files.select("file_id", "columns"), "file_id")
    return named.select("file_id", "line_id", "line_no", F.posexplode(F.arrays_zip("columns", "fields")).alias("position", "x")).select(
        "file_id", "line_id", "line_no", "position", F.col("x.columns").alias("column"), F.trim(F.col("x.fields")).alias("value")
    )
