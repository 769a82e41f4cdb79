import pytest

from lodestrata.operators import sheets

G = "source_id string, sheet string, row_idx int, cells array<string>"


def grid(spark, rows, source="a", sheet="s"):
    return spark.createDataFrame([(source, sheet, i, r) for i, r in enumerate(rows)], G)


def tidy(df):
    return {(r["sample"], r["element"]): (r["status"], r["value"] if r["value"] is not None else r["lod"]) for r in df.collect()}


NORMAL = [
    ["Table S1. Trace elements", None, None, None, None, None],
    [None] * 6,
    ["Sample No.", "Mineral", "Zn (ppm)", "Fe (wt%)", "Cd_ppb", "Ge"],
    ["A-1", "pyrite", "12", "3.5", "2000", "<0.4"],
    ["A-2", "pyrite", "1,200", "bdl", "-", "n/a"],
    ["Mean", "", "606", "3.5", "", ""],
    ["Note: all values by laser ablation of a polished mount.", None, None, None, None, None],
    ["A-3", "galena", ">5", None, "1", "7"],
]


def test_normal_sheet(spark):
    got = tidy(sheets.sheet_measurements(grid(spark, NORMAL)))
    assert got == {
        ("A-1", "zn"): ("value", 12.0), ("A-1", "fe"): ("value", 35000.0), ("A-1", "cd"): ("value", 2.0), ("A-1", "ge"): ("bdl_lod", 0.4),
        ("A-2", "zn"): ("value", 1200.0), ("A-2", "fe"): ("bdl", None), ("A-2", "cd"): ("bdl", None), ("A-3", "zn"): ("value", 5.0), ("A-3", "cd"): ("value", 0.001), ("A-3", "ge"): ("value", 7.0),
    }
    assert {r["mineral"] for r in sheets.sheet_measurements(grid(spark, NORMAL)).collect()} == {"pyrite", "galena"}


def test_unit_row_numbered_header_and_duplicates(spark):
    rows = [["0", "1", "2", "3"], ["Label", "Zn", "Fe", "Zn"], ["", "ppm", "wt%", "ppb"], ["x1", "1", "2", "9"], ["x2", None, "3", "9000"]]
    assert tidy(sheets.sheet_measurements(grid(spark, rows))) == {("x1", "zn"): ("value", 1.0), ("x1", "fe"): ("value", 20000.0), ("x2", "zn"): ("value", 9.0), ("x2", "fe"): ("value", 30000.0)}


def test_transposed_sheet(spark):
    rows = [
        ["", "Spot", "p1", "p2", "Average detection limit"], ["", "Zone", "core", "rim", ""], ["", "Mineral", "pyrite", "pyrite", ""],
        ["", "Zn", "1", "2", "0.1"], ["", "Fe (wt%)", "3", "bdl", "0.1"], ["", "Cd", "5", "6", "0.1"], ["", "Ge", "7", "<8", "1"], ["", "Ag", "9", "10", "1"],
    ]
    got = sheets.sheet_measurements(grid(spark, rows))
    assert tidy(got) == {
        ("p1", "zn"): ("value", 1.0), ("p2", "zn"): ("value", 2.0), ("p1", "fe"): ("value", 30000.0), ("p2", "fe"): ("bdl", None), ("p1", "cd"): ("value", 5.0), ("p2", "cd"): ("value", 6.0),
        ("p1", "ge"): ("value", 7.0), ("p2", "ge"): ("bdl_lod", 8.0), ("p1", "ag"): ("value", 9.0), ("p2", "ag"): ("value", 10.0),
    }
    assert {(r["sample"], r["zone"], r["mineral"]) for r in got.collect()} == {("p1", "core", "pyrite"), ("p2", "rim", "pyrite")}


def test_merged_ids_probe_title_and_citations(spark):
    rows = [["EPMA analyses", "", "", "", "", "", ""], ["Sample", "Spot", "Zn", "Fe", "S", "Total", "Reference"]]
    rows += [[f"M{i // 3}" if i % 3 == 0 else None, str(i), f"{20 + i}", f"{30 + i}", "33", "99", "Lund et al., 2001" if i == 4 else None] for i in range(12)]
    out = sheets.sheet_measurements(grid(spark, rows)).collect()
    assert {r["sample"] for r in out} == {"M0", "M1", "M2", "M3"} and len(out) == 36
    assert {(r["value"], r["spot"]) for r in out if r["row_idx"] == 2 and r["element"] == "zn"} == {(200000.0, "0")}
    assert {r["row_idx"]: r["tag"] for r in out if r["tag"] != "this_study"} == {6: "cited_study:Lund et al., 2001"}


@pytest.mark.parametrize("head,fill,want", [
    (["Spot", "Sample ID", "Zn", "Fe"], lambda i: [None if i else "1", f"s{i}", "1", "2"], "Sample ID"),
    (["Sample ID", "Name", "Zn", "Fe"], lambda i: [f"s{i}", f"n{i}", "1", "2"], "Sample ID"),
    (["ppm", "Rock", "Zn", "Fe"], lambda i: [f"{i}", f"r{i}", "1", "2"], "Rock"),
    (["Zone", "Rock", "Zn", "Fe"], lambda i: ["a", "b", "1", "2"], "Zone"),
])
def test_sample_column(spark, head, fill, want):
    cells = sheets.filled_cells(grid(spark, [head, *map(fill, range(8))]))
    roles = sheets.column_roles(sheets.column_profile(cells, sheets.header_row(cells)))
    assert [r.raw_name for r in roles.where("role = 'sample'").collect()] == [want]


def test_hints_deposits_and_several_files(spark):
    a = grid(spark, [["Name", "Kind", "Deposit", "Zn", "Fe"], ["1", "x", "North", "1", "2"], ["2", "y", "South", "3", "4"]])
    hints = spark.createDataFrame([("a", None, "kind", "wt%", None)], "source_id string, header_row int, sample_column string, unit string, transposed boolean")
    assert tidy(sheets.sheet_measurements(a, hints)) == {("x", "zn"): ("value", 10000.0), ("x", "fe"): ("value", 20000.0), ("y", "zn"): ("value", 30000.0), ("y", "fe"): ("value", 40000.0)}
    assert {r["sample"] for r in sheets.sheet_measurements(a, None, "north").collect()} == {"1"}
    assert {r["sample"] for r in sheets.sheet_measurements(a, None, "east").collect()} == {"1", "2"}
    b = grid(spark, [["Name", "Zn", "Cd"], ["1", "9", "5"], ["3", "6", "7"]], "b")
    both = sheets.merged_files(sheets.sheet_measurements(a.unionByName(b)))
    assert {(r["sample"], r["element"]): r["value"] for r in both.collect()} == {("1", "zn"): 1.0, ("1", "fe"): 2.0, ("1", "cd"): 5.0, ("2", "zn"): 3.0, ("2", "fe"): 4.0, ("3", "zn"): 6.0, ("3", "cd"): 7.0}
    assert sheets.sheet_measurements(a.limit(0)).count() == 0 and sheets.sheet_measurements(grid(spark, [[None], [""], []])).count() == 0
