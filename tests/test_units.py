import pytest

from lodestrata.functions.units import UnitIndex, canonical_aliases, stated_unit, weighted_distance
from lodestrata.operators.unit_convert import convert_units, measured_ppb

M = "meas_id bigint, original_value string, unit string, column_header string, note string, ppb string"


def ppb(spark, rows):
    return {r.meas_id: r.value_ppb for r in measured_ppb(spark.createDataFrame([(*r, "clash") for r in rows], M)).collect()}


def test_values(spark):
    rows = [
        (1, "0.871 ± 0.02 weight percent", "ppb", "Tl", None), (2, "1,234", "ppb", None, None), (3, "1,23", "ppb", None, None), (4, "1,234,567.5 ppb", None, None, None),
        (5, "<5", "ppb", None, None), (6, "-3", "ppb", None, None), (7, "c.40", "ppb", None, None), (8, "~7*", "µg·g⁻¹", None, None), (9, "5 (2σ)", "unknown", "Fe66 (wt%)", None),
        (10, "2", "-", "In in ×10³ ppm", None), (11, "3", None, "Cu", "units: g/t"), (12, "3", None, "Cu", "LOD 0.5 ppm"), (13, "9", " PPM. ", "Cu (wt%)", None),
        (14, "21590000e-6", "per mil", None, None), (15, None, "ppb", None, None), (16, "", "ppb", None, None), (17, "0", "ppb", None, None), (18, "4 ppm", "ppb", None, None),
        (19, "10^3 ppm", None, None, None), (20, "3", None, None, "wt.%; 2 sigma errors in other file"), (20, "3", None, None, "wt.%; 2 sigma errors in other file"),
        (21, "3", "parts per milion", None, None), (22, "5", "furlongs", None, None), (23, ">5", "ppb", None, None), (24, "5.5 ppb " + "x" * 100_000, None, "U (ppb)", None),
    ]
    assert ppb(spark, rows) == {1: 8_710_000, 2: 1234, 3: 1, 4: 1_234_568, 7: 40, 8: 7000, 9: 50_000_000, 10: 2_000_000, 11: 3000, 14: 21_590_000, 17: 0, 20: 30_000_000, 21: 3000, 24: 6}


def test_both_joins_agree_and_empty(spark, tiny):
    assert ppb(spark, []) == {}
    m = spark.read.parquet(f"{tiny}/measurements.parquet")
    args = ("original_value", "unit", "column_header", "note")
    cols = ["meas_id", "original_value", "unit", "_number", "_ppb", "_plain_ppm"]
    a, b, c = (convert_units(m, *args, hot_share=n).select(*cols) for n in (10**9, 300, 1))  # all texts hot, some, none
    for other in (b, c):
        assert a.exceptAll(other).count() == other.exceptAll(a).count() == 0 and other.count() == m.count()


@pytest.mark.parametrize("text,ppm", [("mg/kg", 1), ("MG kg-1", 1), ("g/tonne", 1), ("ng g-1", 1e-3), ("kg/t", 1e3), ("‰", 1e3), ("Wt. pct", 1e4), ("10^3 ppm", 1e3), ("parts per billlion", 1e-3), ("weigth percent", 1e4), ("mg/l", None), ("mf", None), ("", None)])
def test_spellings(text, ppm):
    got = UnitIndex().resolve(text)
    assert got == (None if ppm is None else pytest.approx(ppm * 1000))


def test_symbols_are_never_fuzzy():
    index = UnitIndex()
    for a in canonical_aliases():
        if not a.isalpha() or len(a) < 6:
            assert index.resolve(a + "q") is None


def test_places_that_state_no_unit():
    index = UnitIndex()
    for t in ("spot 40 µm", "2σ 0.04 wt%", "LOD 20 ppb", "units not stated", "re-run", "cited from older table"):
        assert stated_unit("note", t, index) is None
    assert stated_unit("header", "In", index) is None and stated_unit("header", "Bi_mean", index) is None
    assert stated_unit("header", "Li_mean in ppb", index) == (1.0, False)


def test_weighted_distance():
    assert weighted_distance("abc", "abc") == 0 and weighted_distance("mg/kg", "mgkg") == 9 and weighted_distance("milion", "million") == 0.5
