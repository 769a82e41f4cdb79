import random

import pytest

from lodestrata.llm.canonical_mapping import BKTree, edit_distance, entries_within, levenshtein, map_types, nearest_entries

TYPES = [
    ("Q1", "Breccia-chimney uranium", "BCU"), ("Q2", "Breccia-chimney uranium-copper", "BCUCu"), ("Q3", "Black-shale-hosted mercury-antimony", "BSHHgSb"), ("Q4", "Metamorphic lode gold", None),
    ("Q5", "Karst-fill tin", "KFSn"), ("Q6", "Seafloor massive-sulfide zinc-copper-lead", None), ("Q7", "Hot-spring sinter silver-zinc-tin", ""),
]


def plain(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
    return rows[-1][-1]


def test_distances_are_metrics():
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(60)]
    for a in words:
        for b in words:
            assert levenshtein(a, b) == plain(a, b)
            assert edit_distance(a, b) == edit_distance(b, a) and (edit_distance(a, b) == 0) == (a == b)
            assert edit_distance(a, b) <= levenshtein(a, b) <= 2 * edit_distance(a, b)
    for a, b, c in zip(words, words[7:], words[13:]):
        assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)
    assert edit_distance("ab", "ba") == 1 and edit_distance("ca", "abc") == 2


def test_tree_returns_every_entry():
    r = random.Random(4)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(400)}
    tree = BKTree(words)
    for q in list(words)[:40]:
        for k in (0, 1, 2, 3):
            assert [e for _, e in tree.within(q + "a", k)] == [e for _, e in sorted((edit_distance(q + "a", w), w) for w in words) if edit_distance(q + "a", e) <= k]


NAMES = [
    ("Breccia-chimney uranium", "Q1"), ("  BRECCIA  CHIMNEY U deposit", "Q1"), ("Model 56a: Brecica-chimney (uranium) (?)", "Q1"), ("56a u breccia chimney", "Q1"), ("copper + uranium, Breccia chimney; after field notes", "Q2"),
    ("Brecciac-himney Cu–U type", "Q2"), ("possible Black shale hosted Sb/Hg [reclassified]", "Q3"), ("BCUCu deposit", "Q2"), ("bcu", "Q1"), ("Metamoorphic lode Au", "Q4"), ("Metamorphic lode silver", "NONE"), ("vein", "NONE"), ("56a", "NONE"),
    ("Karst-fill", "NONE"), ("uranium", "NONE"), ("Karst fill t1n", "Q5"), ("Karst fill t1m", "NONE"), ("cf. Seaflooor massive sulfide Pb, Zn and Cu mineralisation", "Q6"), ("x" * 5000, "NONE"), ("sivler tin zinc hot spring sinter", "Q7"),
]
BLANK = [(None, "https://m.example/resource/Q2/", "Q2"), (" ", " q3 ", "Q3"), (" ", "https://m.example/Q77", "NONE"), (None, None, None), ("", " ", None), ("vein", "https://m/Q1", "NONE")]


def test_names_and_uris(spark):
    types = spark.createDataFrame(TYPES, "type_id string, deposit_type string, abbrev string")
    asked = [(n, "https://x/Q9", w) for n, w in NAMES] + BLANK
    rows = spark.createDataFrame([("c", i, 0, n, u) for i, (n, u, _) in enumerate(asked)], "origin string, row_key bigint, pos int, name string, uri string")
    want = {i: w for i, (_, _, w) in enumerate(asked) if w}
    for hot in (1, 10**9):  # every spelling by shuffle, or by broadcast
        assert {r.row_key: r.type_id for r in map_types(rows, types, hot_share=hot, part_rows=2 if hot == 1 else 100).collect()} == want


def test_rows(spark):
    types = spark.createDataFrame([(*t, "clash") for t in TYPES] + [(None, "x y", None, "c"), ("Q8", None, None, "c")], "type_id string, deposit_type string, abbrev string, name string")
    rows = spark.createDataFrame([("c", 1, 0, "KFSn", None), ("c", 1, 0, "KFSn", None), ("c", 1, 1, None, None), ("o", 2, 0, "no idea", None)], "origin string, row_key bigint, pos int, name string, uri string")
    assert sorted(tuple(r) for r in map_types(rows, types).collect()) == [("c", 1, 0, "Q5"), ("o", 2, 0, "NONE")]
    assert map_types(rows.limit(0), types).count() == 0
    assert [r.type_id for r in map_types(rows.where("origin = 'o'"), types.limit(0)).collect()] == ["NONE"]


def test_shards_agree_with_one_tree(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcde") for _ in range(6)) for _ in range(300)]
    v = spark.createDataFrame([(w[:5] + "z",) for w in words[:80]] + [(None,), ("zzzzzzzzz",)], "v string")
    e = spark.createDataFrame([(w,) for w in words] + [(None,)], "e string")
    a = sorted(map(tuple, nearest_entries(v, e, 2).collect()), key=repr)
    b = sorted(map(tuple, nearest_entries(v, e, 2, part_rows=40).collect()), key=repr)
    assert a == b and ("zzzzzzzzz", None, None) in a
    best = {w: min((edit_distance(w, x), x) for x in set(words)) for w, _, _ in a}
    assert all((d is None and best[w][0] > 2) or best[w] == (d, x) for w, x, d in a)


def test_every_entry_of_the_shard(spark):
    v = spark.createDataFrame([("x", "abc"), ("x", "abc"), ("y", "abc"), ("z", "abc"), (None, "abc"), ("x", None)], "shard string, value string")
    e = spark.createDataFrame([("x", "abd"), ("x", "abc"), ("x", "bac"), ("y", "abx"), ("y", "qqq"), (None, "abc")], "shard string, entry string")
    got = sorted(map(tuple, entries_within(v, e, 1).collect()))
    assert got == sorted(map(tuple, entries_within(v, e, 1, part_rows=1).collect())) == [("x", "abc", "abc", 0), ("x", "abc", "abd", 1), ("x", "abc", "bac", 1), ("y", "abc", "abx", 1)]
    assert entries_within(v, e.limit(0), 1).count() == 0
