"""Points near other points (complete radius join) and regions that contain points.

The radius join partitions the sphere into Voronoi cells around pivots drawn from the points themselves; a cell with too many
members is divided again by pivots of its own, and so on, so that cells are of bounded size however the points lie, and a point
is measured against a few hundred pivots only. By the triangle inequality a point within r of some point of cell p lies no
farther from p than 2r beyond its own pivot's distance; it is replicated to exactly those cells. Inside a cell a vantage-point
tree answers all of the cell's own points at once with the exact great-circle metric. Each pair comes out of one cell only: that
of its smaller id. A cell that no pivots divide, because its points lie within r of each other, is answered in pairs of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import input_partitions

EARTH_KM = 6371.0088


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> np.ndarray:
    """Haversine distance; exact to rounding also for near points."""
    a, b, c, d = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def usable_points(df: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``(id, lat, lon)`` without null, NaN, out-of-range and exact (0, 0) locations."""
    p = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return p.where(F.col("id").isNotNull() & ok)


class VantageTree:
    """Vantage-point tree over unit vectors; chord length is the metric, monotone in the great-circle distance."""

    LEAF = 96

    def __init__(self, xyz: np.ndarray):
        self.xyz = xyz
        self.root = self._build(np.arange(len(xyz)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.LEAF:
            return idx
        center = self.xyz[idx].mean(axis=0)
        vp = idx[np.argmax(((self.xyz[idx] - center) ** 2).sum(axis=1))]
        d = np.sqrt(((self.xyz[idx] - self.xyz[vp]) ** 2).sum(axis=1))
        mid = np.median(d)
        inner = d <= mid
        if inner.all() or not inner.any():
            return idx  # all at one distance: a leaf, searched in blocks
        return vp, (d[inner].max(), self._build(idx[inner])), (d[~inner].min(), d[~inner].max(), self._build(idx[~inner]))

    def candidates(self, queries: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, member positions) whose product holds every pair within chord r; the blocks are disjoint."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                yield q, node
                continue
            vp, (hi, inner), (lo, far, outer) = node
            d = np.sqrt(((queries[q] - self.xyz[vp]) ** 2).sum(axis=1))
            stack.append((inner, q[d - r <= hi]))
            stack.append((outer, q[(d + r >= lo) & (d - r <= far)]))


def _pairs_of_cell(ids, lat, lon, own, side, km: float, radius: float, block: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller id, larger id) within km, the smaller one the cell's own, in steps of bounded memory. Where the members are of two
    blocks of a cell (side 1 and 2), only pairs across them."""
    crossed = bool(side[0])
    xyz = unit_vectors(lat, lon)
    chord = 2 * np.sin(min(np.pi / 2, km / radius / 2)) * (1 + 1e-9) + 1e-12
    tree = VantageTree(xyz)
    mine = np.flatnonzero(own)
    for q, members in tree.candidates(xyz[mine], chord):
        q = mine[q]
        step = max(1, block // max(1, len(members)))
        for s in range(0, len(q), step):
            a, b = np.meshgrid(q[s : s + step], members, indexing="ij")
            a, b = a.ravel(), b.ravel()
            keep = (ids[a] < ids[b]) & (side[a] != side[b]) if crossed else ids[a] < ids[b]
            a, b = a[keep], b[keep]
            keep = great_circle_km(lat[a], lon[a], lat[b], lon[b], radius) <= km
            if keep.any():
                yield ids[a[keep]], ids[b[keep]]


def _spaced(xyz: np.ndarray, least: float) -> np.ndarray:
    """Places of vectors kept in order so that no two kept ones are nearer than ``least``."""
    kept: list[int] = []
    for i, x in enumerate(xyz):
        if not kept or ((xyz[kept] - x) ** 2).sum(axis=1).min() >= least * least:
            kept.append(i)
    return np.array(kept, dtype=int)


def _spread(ids: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each id, evenly spread whatever the ids are."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53


class CellTree:
    """Nested Voronoi cells. A node is a cell; one with pivots is divided into its children, in order of the pivots."""

    def __init__(self, chord: float):
        self.chord = chord
        self.pivots: dict[int, np.ndarray] = {}
        self.children: dict[int, np.ndarray] = {}
        self.blocks: dict[int, int] = {}
        self.nodes = 1

    def divide(self, node: int, pivots: np.ndarray) -> None:
        self.pivots[node] = pivots
        self.children[node] = np.arange(self.nodes, self.nodes + len(pivots))
        self.nodes += len(pivots)

    def members(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the point, leaf, own): each point in the cell it belongs to and in all that hold a point within the chord of it.

        At each level a point goes to the children whose pivot lies no farther than its nearest one plus two chords.
        """
        rows, leaves, owns = [], [], []
        stack = [(0, np.arange(len(xyz)), np.ones(len(xyz), bool))]
        while stack:
            node, at, own = stack.pop()
            if node not in self.pivots:
                rows.append(at)
                leaves.append(np.full(len(at), node))
                owns.append(own)
                continue
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (xyz[at] @ self.pivots[node].T)))
            home = d.argmin(axis=1)
            # 1e-7 covers the rounding of the dot products
            row, child = np.nonzero(d <= (d[np.arange(len(d)), home] + 2 * self.chord + 1e-7)[:, None])
            owned = own[row] & (home[row] == child)
            order = np.argsort(child, kind="stable")
            row, child, owned = row[order], child[order], owned[order]
            cuts = np.flatnonzero(np.diff(child)) + 1
            inner = {i for i, c in enumerate(self.children[node]) if c in self.pivots}
            keep = np.ones(len(row), bool)
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(child)]):
                if e > s and int(child[s]) in inner:
                    stack.append((int(self.children[node][child[s]]), at[row[s:e]], owned[s:e]))
                    keep[s:e] = False
            rows.append(at[row[keep]])
            leaves.append(self.children[node][child[keep]])
            owns.append(owned[keep])
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(owns)


def cell_tree(points: DataFrame, n: int, chord: float, cell_points: int, fan: int, max_pivots: int) -> CellTree:
    """Cells of ``n`` points divided until none has more than ``cell_points`` members, or none of those can be.

    A level is one pass that counts the leaves' members and one that draws pivots for those too large, by a hash of the ids, none
    nearer than the chord to another. The driver holds and every task is sent at most ``max_pivots`` pivots (24 bytes each).
    """
    tree = CellTree(chord)
    sizes, whole = {0: n}, set()
    while True:
        large = sorted((c for c, m in sizes.items() if m > (cell_points if tree.nodes > 1 else min(cell_points, 512)) and c not in whole), key=lambda c: -sizes[c])
        want, drawn = {}, 0
        for c in large:
            k = int(min(fan, max(2, -(-4 * sizes[c] // cell_points) if tree.nodes > 1 else max(n // 256, 4 * n // cell_points))))
            if tree.nodes + drawn + k > max_pivots:
                break
            want[c] = k
            drawn += k
        if not want:
            break
        share = {c: min(1.0, 4.0 * k / sizes[c]) for c, k in want.items()}

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, lat, lon = (b.column(c).to_numpy() for c in ("id", "lat", "lon"))
                luck = _spread(ids)
                some = np.flatnonzero(luck < max(share.values()))
                row, leaf, own = tree.members(unit_vectors(lat[some], lon[some])) if len(some) else (some, some, some)
                row = some[row]
                keep = np.array([bool(o) and luck[r] < share.get(int(c), 0.0) for r, c, o in zip(row, leaf, own)], dtype=bool)
                row, leaf = row[keep], leaf[keep]
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(luck[row], pa.float64()), pa.array(lat[row]), pa.array(lon[row])], names=["cell", "luck", "lat", "lon"])

        found = points.mapInArrow(draw, "cell bigint, luck double, lat double, lon double").toPandas().sort_values(["cell", "luck", "lat", "lon"])
        before = dict(sizes)
        divided = {}
        for c in want:
            some = found[found["cell"] == c].head(want[c])
            xyz = unit_vectors(some["lat"].to_numpy(), some["lon"].to_numpy())
            xyz = xyz[_spaced(xyz, chord)]
            if len(xyz) < 2:
                whole.add(c)  # its points lie within the radius of each other
            else:
                tree.divide(c, xyz)
                divided[c] = tree.children[c]
        if not divided:
            continue

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(tree.nodes, dtype=np.int64)
            for b in batches:
                lat, lon = b.column("lat").to_numpy(), b.column("lon").to_numpy()
                for s in range(0, len(lat), 8192):
                    total += np.bincount(tree.members(unit_vectors(lat[s : s + 8192], lon[s : s + 8192]))[1], minlength=tree.nodes)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

        sizes = {r["cell"]: r["n"] for r in points.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        for c, parts in divided.items():  # a part with nearly all its cell held: more pivots would only copy
            whole |= {int(p) for p in parts if sizes.get(int(p), 0) > 0.9 * before[c]}
    tree.blocks = {c: int(-(-m // cell_points)) for c, m in sizes.items() if m > cell_points}
    tree.sizes = sizes
    return tree


def near_pairs(
    points: DataFrame, km: float, radius: float = EARTH_KM, cell_points: int = 20_000, fan: int = 256, max_pivots: int = 1_000_000
) -> DataFrame:
    """Every pair of ``points(id, lat, lon)`` at most ``km`` apart, as ``(id_a, id_b)`` with id_a < id_b, each once.

    Ids are unique; points at one place are ordinary points. Only the cells depend on the pivots drawn, never the result. Cells
    with more than ``cell_points`` members are divided; those that can't be, as all their points are within the radius, are cut
    into blocks of so many and each pair of blocks is one group, so that no task holds more than two blocks, and what is copied is a
    small share of the pairs that come out. Cells are read one at a time from sorted partitions and pairs leave in bounded batches.
    An empty table gives an empty result.
    """
    spark = points.sparkSession
    n = points.count()
    chord = 2 * np.sin(min(np.pi / 2, km / radius / 2)) * (1 + 1e-9) + 1e-12
    tree = cell_tree(points, n, chord, cell_points, fan, max_pivots)
    blocks = tree.blocks

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lat, lon = (b.column(c).to_numpy() for c in ("id", "lat", "lon"))
            for s in range(0, len(lat), 8192):
                row, leaf, own = tree.members(unit_vectors(lat[s : s + 8192], lon[s : s + 8192]))
                many = np.isin(leaf, list(blocks)) if blocks else np.zeros(len(leaf), bool)
                parts = [(row[~many], leaf[~many] << 32, own[~many], np.zeros((~many).sum(), np.int8))]
                for c in np.unique(leaf[many]).tolist():
                    m, here = blocks[c], np.flatnonzero(leaf == c)
                    mine = np.repeat((_spread(ids[s + row[here]]) * m).astype(np.int64), m)
                    other = np.tile(np.arange(m), len(here))
                    pair = np.minimum(mine, other) * m + np.maximum(mine, other)
                    parts.append((np.repeat(row[here], m), (c << 32) + pair, np.repeat(own[here], m), np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.int8)))
                for row_, cell, own_, side in parts:
                    for lo in range(0, len(row_), 100_000):
                        r = s + row_[lo : lo + 100_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in (cell[lo : lo + 100_000], own_[lo : lo + 100_000], side[lo : lo + 100_000], ids[r], lat[r], lon[r])],
                            names=["cell", "own", "side", "id", "lat", "lon"],
                        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            held, at = [], None
            for b in batches:
                cells = b.column("cell").to_numpy()
                cuts = np.flatnonzero(np.diff(cells)) + 1
                for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(cells)]):
                    if e <= s:
                        continue
                    if cells[s] != at and held:
                        yield held
                        held = []
                    at = cells[s]
                    held.append(b.slice(s, e - s))
            if held:
                yield held

        out_a, out_b, size = [], [], 0
        for held in groups():
            t = pa.Table.from_batches(held)
            cols = [t.column(c).to_numpy() for c in ("id", "lat", "lon", "own", "side")]
            if not cols[3].any():
                continue
            for a, b in _pairs_of_cell(*cols, km, radius):
                for s in range(0, len(a), 250_000):
                    out_a.append(a[s : s + 250_000])
                    out_b.append(b[s : s + 250_000])
                    size += len(out_a[-1])
                    if size >= 250_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["id_a", "id_b"])
                        out_a, out_b, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["id_a", "id_b"])

    groups = len(tree.sizes) + sum(m * (m + 1) // 2 for m in blocks.values())
    parts = max(input_partitions(spark), min(groups, (sum(tree.sizes.values()) + sum(tree.sizes[c] * m for c, m in blocks.items())) // 8192))
    cells = points.mapInArrow(assign, "cell bigint, own boolean, side byte, id bigint, lat double, lon double")
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(join, "id_a bigint, id_b bigint")


def parse_rings(wkt: str | None) -> list[np.ndarray]:
    """Rings of a POLYGON or MULTIPOLYGON as (n, 2) arrays of lon, lat; nothing for null or other texts."""
    if not wkt or not re.match(r"\s*(MULTI)?POLYGON", wkt, re.I):
        return []
    rings = []
    for body in re.findall(r"\(([^()]+)\)", wkt):
        xy = np.array([[float(v) for v in p.split()[:2]] for p in body.split(",")])
        if len(xy) >= 3:
            rings.append(xy if (xy[0] == xy[-1]).all() else np.vstack([xy, xy[:1]]))
    return rings


def inside_rings(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings: holes and several parts need no case of their own."""
    odd = np.zeros(len(x), dtype=bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r[:-1], r[1:]):
            if y1 == y2:
                continue
            hit = (y1 > y) != (y2 > y)
            odd ^= hit & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def containing_regions(
    points: DataFrame, regions: DataFrame, region_id: str, wkt: str, max_sent_mb: int = 16, grid_degrees: float = 1.0
) -> DataFrame:
    """``(id, region_id)`` for each region of plain lon/lat that a point lies in.

    Regions of up to ``max_sent_mb`` of text are sent to every task, tested by bounding box and then exactly; beyond that
    both sides meet in an equi-join on grid squares of ``grid_degrees``. Null or unreadable outlines contain nothing.
    """
    r = regions.select(F.col(region_id).cast("bigint").alias("region_id"), F.col(wkt).alias("wkt")).where("region_id IS NOT NULL AND wkt IS NOT NULL")
    mb = (r.agg(F.sum(F.length("wkt"))).first()[0] or 0) / 1e6
    if mb <= max_sent_mb:
        shapes = [(row["region_id"], parse_rings(row["wkt"])) for row in r.collect()]
        shapes = [(i, rings, np.vstack(rings).min(axis=0), np.vstack(rings).max(axis=0)) for i, rings in shapes if rings]

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y, x, ids = (b.column(c).to_numpy() for c in ("lat", "lon", "id"))
                for i, rings, low, high in shapes:
                    near = np.flatnonzero((x >= low[0]) & (x <= high[0]) & (y >= low[1]) & (y <= high[1]))
                    near = near[inside_rings(rings, x[near], y[near])] if len(near) else near
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(np.full(len(near), i))], names=["id", "region_id"])

        return points.mapInArrow(test, "id bigint, region_id bigint")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column("region_id").to_pylist(), b.column("wkt").to_pylist()):
                rings = parse_rings(text)
                if not rings:
                    continue
                low, high = (np.floor(f(np.vstack(rings), axis=0) / grid_degrees).astype(int) for f in (np.min, np.max))
                gx, gy = (a.ravel() for a in np.meshgrid(np.arange(low[0], high[0] + 1), np.arange(low[1], high[1] + 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gx), i)), pa.array([text] * len(gx)), pa.array(gx), pa.array(gy)], names=["region_id", "wkt", "gx", "gy"]
                )

    squares = r.mapInArrow(cover, "region_id bigint, wkt string, gx bigint, gy bigint")
    placed = points.withColumn("gx", F.floor(F.col("lon") / grid_degrees)).withColumn("gy", F.floor(F.col("lat") / grid_degrees))

    @F.pandas_udf("boolean")
    def within(text, x, y):
        out = np.zeros(len(x), dtype=bool)
        for t, at in x.groupby(text).groups.items():
            out[x.index.get_indexer(at)] = inside_rings(parse_rings(t), x[at].to_numpy(), y[at].to_numpy())
        return type(x)(out)

    return placed.join(squares.hint("merge"), ["gx", "gy"]).where(within("wkt", "lon", "lat")).select("id", "region_id")


def surroundings(usmin: DataFrame, sedau: DataFrame, tracts: DataFrame, km: float = 2.0) -> DataFrame:
    """``(kind, id_a, id_b)``: 'near' pairs of site records within ``km`` and 'inside' (record, tract)."""
    points = usable_points(usmin, "rec_id").unionByName(usable_points(sedau, "rec_id"))
    near = near_pairs(points, km).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = containing_regions(points, tracts, "tract_id", "wkt").select(F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("region_id").alias("id_b"))
    return near.unionByName(inside)
