"""Sheets, archives, HTML tables and JSON records read into generic grids and records, any number of files at once."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of sheet names that hold no samples.
SKIPPED_SHEETS = ["lod", "standard", "blank"]
ENCODINGS = ["utf-8", "utf-8-sig", "latin-1", "cp1252"]
_GRID = "source_id string, sheet string, row_idx int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode("utf-8-sig" if encoding == "utf-8" and raw[:3] == b"\xef\xbb\xbf" else encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def csv_rows(raw: bytes) -> list[list[str]]:
    text = decode(raw)
    first = text[:4096]
    delim = max(",;\t|", key=first.count)
    return [list(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=delim)]


def workbook_rows(raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of an OOXML workbook, by the standard library alone; gaps are empty cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            path = targets[sheet.get(f"{_REL}id")].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            rows: list[list[str]] = []
            for row in ET.fromstring(z.read(path)).iter(f"{_MAIN}row"):
                while len(rows) < int(row.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    while letters and len(cells) < at - 1:
                        cells.append("")
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                    elif v is None:
                        cells.append("")
                    else:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                rows.append(cells)
            yield sheet.get("name"), rows


def file_grids(path: str, raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Sheets of a file by its suffix; archives are opened, resource forks and other files passed over."""
    low = path.lower()
    if low.endswith((".csv", ".tsv", ".txt")):
        yield "", csv_rows(raw)
    elif low.endswith((".xlsx", ".xlsm")):
        for name, rows in workbook_rows(raw):
            if not any(w in name.lower() for w in SKIPPED_SHEETS):
                yield name, rows
    elif low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for inner in sorted(z.namelist()):
                if not inner.startswith("__MACOSX") and not inner.endswith("/"):
                    for name, rows in file_grids(inner, z.read(inner)):
                        yield f"{inner}#{name}" if name else inner, rows


def read_grids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All sheets of all files as one grid. Unreadable files give one row with sheet '!error' and the message as its cell."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                try:
                    out = [(path, sheet, i, cells) for sheet, rows in file_grids(path, bytes(raw)) for i, cells in enumerate(rows)]
                except Exception as e:  # one bad file must not end the batch
                    out = [(path, "!error", 0, [f"{type(e).__name__}: {e}"])]
                yield pd.DataFrame(out, columns=["source_id", "sheet", "row_idx", "cells"])

    return files.mapInPandas(run, _GRID)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.stack: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.stack.append([])
        elif tag == "tr" and self.stack:
            self.stack[-1].append([])
        elif tag in ("td", "th") and self.stack and self.stack[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.stack[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.stack:
            self.tables.append(self.stack.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Every table of every page as a grid, sheet = table number within the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, h in zip(b["i"], b["h"]):
                p = _Tables()
                p.feed(h or "")
                out += [(i, str(k), r, cells) for k, t in enumerate(p.tables, 1) for r, cells in enumerate(t)]
            yield pd.DataFrame(out, columns=["source_id", "sheet", "row_idx", "cells"])

    return pages.select(F.col(page_id).cast("string").alias("i"), F.col(html).alias("h")).mapInPandas(run, _GRID)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON records, one a file, as ``(path, record VARIANT)``; texts that don't parse have a null record."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("record"))


def record_fields(records: DataFrame) -> DataFrame:
    """Name, position and commodities of polymorphic site records: each is looked for at the places it is known to stand."""
    g = lambda p, t: F.try_variant_get("record", p, t)
    return records.select(
        "path",
        F.coalesce(g("$.properties.name[0].name", "string"), g("$.properties.name", "string"), g("$.name[0].name", "string"), g("$.name[0]", "string"), g("$.name", "string"), g("$.site_name", "string")).alias("name"),
        F.coalesce(g("$.geometry.coordinates[0][1]", "double"), g("$.geometry.coordinates[1]", "double"), g("$.latitude", "double")).alias("lat"),
        F.coalesce(g("$.geometry.coordinates[0][0]", "double"), g("$.geometry.coordinates[0]", "double"), g("$.longitude", "double")).alias("lon"),
        F.coalesce(g("$.properties.commodity[0].commod", "string"), g("$.commodity[0].commod", "string"), g("$.commodity[0].name", "string"), g("$.commodity[0].value", "string"), g("$.commodity[0]", "string"), g("$.commodity", "string")).alias("commodity"),
    )
