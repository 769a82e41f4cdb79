import pytest
from pyspark.sql import functions as F

from lodestrata.llm.entity_matching import commodity_symbols, close_cores, core_dictionary, edit_keys, match_entities, propagate, read_name, unmangle, written_names

S = "rec_id bigint, src string, name string, country string, state string, lat double, lon double, goods string, core string"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], S)
    return {(r.rec_a, r.rec_b) for r in match_entities(df).where("confidence >= 0.5").collect()}


@pytest.mark.parametrize("name,want", [
    ("Mt. Vuvasdal, South", ("vuvasdal", "S", "mount")), ("Lake, Seiflei Krelam", ("seifleikrelam", "", "lake")), ("Mopiawi (No. 3) Prospect", ("mopiawi", "3", "")), ("Zageiskarkbroem  I", ("zageiskarkbroem", "1", "")),
    ("PIAFLAIM NR 2 OCCURRENCE", ("piaflaim", "2", "")), ("Wáux Knob (Lwr) Mine", ("waux", "LOW", "knob")), ("TunheiskiÃ¡ Flat, #2", ("tunheiskia", "2", "flat")), ("", ("", "", "")),
])
def test_names(name, want):
    assert read_name(name) == want


def test_lists_aliases_goods():
    assert written_names("['Alpha Mine', 'Beta']") == ["Alpha Mine", "Beta"] and set(map(str.strip, written_names("Alpha (Beta)"))) == {"Alpha", "Beta"} and written_names(None) == []
    assert commodity_symbols("zinc/Cu, Pb") == ["Cu", "Pb", "Zn"] and commodity_symbols(None) == [] and unmangle("BemÃ©nd") == "Beménd"


def test_matches(spark):
    rows = [
        (1, "sedau", "Velorabrin Creek Mine", "Norland", None, 10.0, 20.0, "zinc"), (2, "usmin", "VELORABRIN CK.", None, "Gor State", 10.004, 20.003, "Zn"), (3, "site", "Velorabirn Creek", "NOR", "Gor", 10.0, 20.01, "zinc"),
        (4, "usmin", "Velorabrin Creek North", None, "Gor", 10.001, 20.001, "Zn"), (5, "site", "Velorabrin Creek N. Prospect", "NOR", "Gor", None, None, "Zn"),
        (6, "sedau", "Kelmoradin", "Norland", None, -12.0, 44.0, "gold"), (7, "usmin", "Kelmoradin", None, None, 12.0, 44.0, "Au"), (8, "site", "Kelmoradin", None, None, 70.0, 100.0, "lead"),
        (9, "sedau", None, None, None, None, None, None), (10, "usmin", "NA", None, None, None, None, None), (11, "site", "x" * 10_000, None, None, 1.0, 1.0, None),
        (12, "sedau", "Unnamed", "Norland", None, 33.12345, 44.54321, "tin"), (13, "usmin", "unnamed prospect", None, None, 33.12350, 44.54325, "Sn"),
        (14, "sedau", "Velorabrin Creek", "Norland", None, 10.001, 20.001, "zinc"),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3), (2, 14), (3, 14), (4, 5), (6, 7), (12, 13)}


def test_one_to_one_prefers_the_better(spark):
    base = dict(country=None, state=None, goods=None)
    rows = [(1, "sedau", "Velorabrin", None, None, 10.0, 20.0, "zinc"), (2, "usmin", "Velorabrin", None, None, 10.001, 20.0, "Zn"), (3, "usmin", "Velorabrin", None, None, 10.3, 20.0, None)]
    assert pairs(spark, rows) == {(1, 2)} and base


def test_propagation_of_competing_places(spark):
    e = spark.createDataFrame([(1, 11, "a", "b", "x", "p", 3.0), (1, 12, "a", "b", "x", "q", 1.0), (2, 12, "a", "b", "y", "q", 2.0)], "rec_a bigint, rec_b bigint, src_a string, src_b string, sig_a string, sig_b string, w double")
    c = {(r.rec_a, r.rec_b): r.confidence for r in propagate(e).collect()}
    # exact marginals over the matchings of this tree: weights of {}, {1-11}, {1-12}, {2-12}, {1-11, 2-12}
    import math

    z = 1 + math.exp(3) + math.exp(1) + math.exp(2) + math.exp(5)
    assert c[1, 11] == pytest.approx((math.exp(3) + math.exp(5)) / z, abs=1e-3) and c[1, 12] == pytest.approx(math.exp(1) / z, abs=1e-3) and c[2, 12] == pytest.approx((math.exp(2) + math.exp(5)) / z, abs=1e-3)


def test_core_dictionary(spark):
    c = spark.createDataFrame([("velorabrin", 5), ("velorabirn", 1), ("velorabrn", 1), ("velorabrinx", 1), ("kelmoradin", 4), ("abc", 9), ("abd", 1)], "core string, n bigint")
    assert {r.core: r.canonical for r in core_dictionary(c).collect()} == {"velorabirn": "velorabrin", "velorabrn": "velorabrin", "velorabrinx": "velorabrin"}


def test_empty(spark):
    assert match_entities(spark.createDataFrame([], S)).count() == 0


def test_a_name_that_a_third_of_all_records_bear(spark):
    rows = [(i, ("sedau", "usmin", "site")[i % 3], "Common Stock" if i % 3 else "Common Stock Mine", None, None, 10 + i * 0.01, 20.0 + 0.00013, None) for i in range(600)]
    df = spark.createDataFrame([(*r, "c") for r in rows], S)
    assert match_entities(df).where(F.col("confidence") >= 0.5).count() == 0


def test_an_over_shared_name_still_tells_under_entry_errors(spark):
    """210 places of one name, each in two indexes: coordinates rounded, swapped, sign-flipped, 800 m off, 20 m off, or missing."""
    slip = [lambda y, x: (round(y, 2), round(x, 2)), lambda y, x: (x, y), lambda y, x: (-y, x), lambda y, x: (y + 0.0072, x), lambda y, x: (y + 0.0002, x)]
    rows = []
    for i in range(210):
        y, x = 10.01234 + i % 20 * 0.5, 30.04321 + i // 20 * 0.5
        rows += [(i, "sedau", "Harrowdel Hill", None, None, y, x, "zinc"), (1000 + i, "usmin", "Harrowdel Hill Mine", None, None, *slip[i % 5](y, x), "Zn")]
    rows += [(500, "sedau", "Harrowdel Hill", None, None, None, None, "tin"), (1500, "usmin", "Harrowdel Hill", None, None, -40.01234, 100.04321, "Sn")]
    assert pairs(spark, rows) == {(i, 1000 + i) for i in range(210)} | {(500, 1500)}


def test_a_name_borne_in_many_areas_is_a_name(spark):
    rows = [r for i in range(6) for r in ((i, "sedau", "Talmerin", None, None, 5.0 + 7 * i, 20.0 + 9 * i, "zinc"), (10 + i, "usmin", "Talmerin", None, None, 5.004 + 7 * i, 20.0 + 9 * i, "Zn"))]
    assert pairs(spark, rows) == {(i, 10 + i) for i in range(6)}


def test_misspelt_names_meet_where_they_lie(spark):
    """One edit in a short core, two edits from an attested core, two edits of seven letters, across a degree line and the date line."""
    names = [("Velka", "Velka Mine", "Velca"), ("Torambel", "Torambel", "Toranbal"), ("Kisarun", "", "Kasaron"), ("Dovrin", "", "Dorvni")]
    at = [(10.0, 20.0), (-30.00001, 45.0), (60.0, 100.99999), (5.0, 179.9999)]
    rows = []
    for i, ((a, more, b), (y, x)) in enumerate(zip(names, at)):
        rows += [(i, "sedau", a, None, None, y, x, "zinc"), (10 + i, "usmin", b, None, None, y + 0.0021, x + 0.0002 if i < 3 else -179.9999, "Zn")]
        rows += [(20 + i, "site", more, None, None, y, x + 0.001, "zinc")] if more else []
    rows += [(40, "sedau", "Velka", None, None, 40.0, 20.0, "zinc"), (41, "usmin", "Tarko", None, None, 40.0, 20.001, "Zn"), (42, "usmin", "Velca North", None, None, 40.0, 20.001, "Zn")]
    assert pairs(spark, rows) == {(i, 10 + i) for i in range(4)} | {(0, 20), (10, 20), (1, 21), (11, 21)}


def test_spots_reach_as_far_at_any_latitude_and_over_the_date_line(spark):
    rows = [(1, "sedau", "Unnamed", None, None, 80.00011, 20.00099, "tin"), (2, "usmin", None, None, None, 80.00013, 20.00311, "Sn")]
    rows += [(3, "sedau", "Unnamed", None, None, 10.00011, 179.99993, "tin"), (4, "usmin", None, None, None, 10.00013, -179.99994, "Sn")]
    assert pairs(spark, rows) == {(1, 2), (3, 4)}


def test_propagation_goes_on_until_it_settles(spark):
    import math

    e = spark.createDataFrame([(1, 11, "a", "b", "x", "p", 3.0), (1, 12, "a", "b", "x", "q", 1.0), (2, 12, "a", "b", "y", "q", 2.0)], "rec_a bigint, rec_b bigint, src_a string, src_b string, sig_a string, sig_b string, w double")
    z = 1 + math.exp(3) + math.exp(1) + math.exp(2) + math.exp(5)
    c = {(r.rec_a, r.rec_b): r.confidence for r in propagate(e, rounds=1).collect()}
    assert c[1, 11] == pytest.approx((math.exp(3) + math.exp(5)) / z, abs=2e-3) and c[1, 12] == pytest.approx(math.exp(1) / z, abs=2e-3)
    with pytest.raises(RuntimeError, match="still move"):
        propagate(e, most=1)


def test_words_few_edits_apart_share_a_key(spark):
    """Two edits, swaps of neighbours among them, leave a shared key at any length, the seam of the two kinds of keys included."""
    import random

    from lodestrata.llm.canonical_mapping import edit_distance

    r = random.Random(3)

    def edited(w):
        i, k = r.randrange(len(w)), r.randrange(4)
        return [w[:i] + w[i + 1 :], w[:i] + r.choice("abcd") + w[i:], w[:i] + r.choice("abcd") + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]][k]

    for n in range(2, 60):
        for _ in range(20):
            w = "".join(r.choice("abcd") for _ in range(n))
            for times, other in ((1, edited(w)), (2, edited(edited(w) or "a"))):
                at, keys = edit_keys([w, other], times)
                assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist()), (w, other)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(4, 7))) for _ in range(60)})
    df = spark.createDataFrame([(w, 1) for w in words], "core string, n long")
    for most in (1, 2):
        got = {(x.core_a, x.core_b) if x.core_a < x.core_b else (x.core_b, x.core_a) for x in close_cores(df, most).collect()}
        assert got == {(a, b) for a in words for b in words if a < b and edit_distance(a, b) <= most}
