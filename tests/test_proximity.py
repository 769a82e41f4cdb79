import numpy as np
import pandas as pd

from lodestrata.operators.proximity import containing_regions, great_circle_km, near_pairs, surroundings, usable_points


def brute(p, km):
    out = set()
    for i in range(len(p)):
        d = great_circle_km(p.lat[i], p.lon[i], p.lat.to_numpy(), p.lon.to_numpy())
        out |= {(min(p.id[i], j), max(p.id[i], j)) for j in p.id[d <= km] if j != p.id[i]}
    return out


def points(seed=1):
    r = np.random.default_rng(seed)
    lat = np.concatenate([r.normal(10, 0.02, 300), r.uniform(-90, 90, 200), [89.999, 89.9995, -90, 0, 0, 5, 5, 5], r.normal(0, 0.01, 60)])
    lon = np.concatenate([r.normal(20, 0.02, 300), r.uniform(-180, 180, 200), [10, -170, 3, 179.999, -179.999, 6, 6, 6], np.where(r.random(60) < 0.5, 179.995, -179.995)])
    return pd.DataFrame({"id": np.arange(len(lat)) * 7 + 3, "lat": lat, "lon": lon})


def test_pairs_equal_brute_force(spark):
    p = points()
    for km, most in ((2.0, 40), (25.0, 64), (0.0, 32)):
        got = near_pairs(spark.createDataFrame(p), km, cell_points=most, fan=8).collect()
        pairs = {(r.id_a, r.id_b) for r in got}
        assert len(pairs) == len(got) and pairs == brute(p, km)


def test_one_hot_place(spark):
    p = pd.DataFrame({"id": range(400), "lat": [1.0] * 400, "lon": [2.0] * 400})
    for block in (20_000, 64):
        got = near_pairs(spark.createDataFrame(p), 2.0, cell_points=block)
        assert got.count() == got.distinct().count() == 400 * 399 // 2


def test_dense_place_in_blocks_equals_brute_force(spark):
    r = np.random.default_rng(6)
    p = pd.DataFrame({"id": np.arange(1500) * 3, "lat": r.normal(10, 0.02, 1500), "lon": r.normal(20, 0.02, 1500)})
    got = near_pairs(spark.createDataFrame(p), 2.0, cell_points=100).collect()
    assert len(got) == len({(x.id_a, x.id_b) for x in got}) and {(x.id_a, x.id_b) for x in got} == brute(p, 2.0)


def test_a_third_of_the_points_in_one_place(spark):
    """A dense district wider than the radius is divided again; a single spot that can't be is cut into blocks; no cell stays large."""
    from lodestrata.operators.proximity import cell_tree, unit_vectors

    r = np.random.default_rng(8)
    lat = np.concatenate([r.normal(40, 0.5, 2000), np.full(1200, 12.0), r.uniform(-80, 80, 800)])
    lon = np.concatenate([r.normal(9, 0.5, 2000), np.full(1200, 13.0), r.uniform(-180, 180, 800)])
    p = pd.DataFrame({"id": np.arange(4000) * 5 + 1, "lat": lat, "lon": lon})
    df = spark.createDataFrame(p)
    tree = cell_tree(df, 4000, 0.1 / 6371, 200, 16, 10_000)
    assert max(m for c, m in tree.sizes.items() if c not in tree.blocks) <= 200 and len(tree.blocks) == 1 and len(tree.pivots) > 1
    got = near_pairs(df, 0.1, cell_points=200, fan=16).collect()
    assert len(got) == len({(x.id_a, x.id_b) for x in got}) and {(x.id_a, x.id_b) for x in got} == brute(p, 0.1)
    row, leaf, own = tree.members(unit_vectors(lat, lon))
    assert sorted(row[own].tolist()) == list(range(4000))


def test_unusable_and_empty(spark):
    s = "rec_id bigint, latitude double, longitude double, id string, cell int"
    rows = [(1, 0.0, 0.0), (2, None, 1.0), (3, 91.0, 0.0), (4, 10.0, 181.0), (5, float("nan"), 1.0), (6, 5.0, 5.0), (7, 5.001, 5.001), (8, 0.0, 1.0)]
    a = spark.createDataFrame([(*r, "x", 1) for r in rows], s)
    none = spark.createDataFrame([], s)
    tracts = spark.createDataFrame([(9, "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))"), (10, None), (11, "POINT (1 1)"), (12, "MULTIPOLYGON (((4 4, 6 4, 6 6, 4 6, 4 4), (4.5 4.5, 5.5 4.5, 5.5 5.5, 4.5 5.5, 4.5 4.5)), ((0.5 -1, 2 -1, 2 1, 0.5 1, 0.5 -1)))")], "tract_id bigint, wkt string")
    got = sorted(tuple(r) for r in surroundings(a, none, tracts).collect())
    assert got == [("inside", 6, 9), ("inside", 7, 9), ("inside", 8, 12), ("near", 6, 7)]
    assert surroundings(none, none, tracts).count() == 0 and surroundings(none, none, tracts.limit(0)).count() == 0


def test_regions_by_grid_equal_sent_regions(spark, tiny):
    p = usable_points(spark.read.parquet(f"{tiny}/usmin_sn.parquet"), "rec_id")
    t = spark.read.parquet(f"{tiny}/tracts.parquet")
    a, b = (containing_regions(p, t, "tract_id", "wkt", max_sent_mb=mb) for mb in (16, -1))
    assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
