"""Overlays, point joins and nearest places on polygons of many vertices, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopressure.functions import exprs as X
from geopressure.operators import geometry as G
from geopressure.plans import serve


def star(n, cx, cy, inner, outer, seed, turn=1):
    """A wavy ring of ``n`` vertices between two distances from a centre, as rough as its edges are long."""
    rng = random.Random(seed)
    middle, half = (inner + outer) / 2, (outer - inner) / 2
    distance = lambda t: middle + half * math.sin(7 * t) * 0.9 + rng.uniform(-1, 1) * middle / n
    at = [(2 * math.pi * k / n, distance(2 * math.pi * k / n)) for k in range(n)]
    ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in at]
    return ring[::turn]


def ring_edges(ring):
    return [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


def holed(n, cx, cy, seed):
    """An outer ring counter-clockwise and a hole clockwise, ``n`` vertices each."""
    return [(0, e) for e in ring_edges(star(n, cx, cy, 80, 100, seed))] + [(1, e) for e in ring_edges(star(n, cx, cy, 30, 40, seed + 1, -1))]


def table(spark, polygons, key):
    rows = [(k, ring, *map(float, e)) for k, edges in polygons.items() for ring, e in edges]
    return spark.createDataFrame(rows, f"{key} string, ring int, x1 double, y1 double, x2 double, y2 double")


def shared_area(a, b):
    """The signed sum over every pair of edges."""
    a, b = (np.array([e for _, e in p if e[0] != e[2]]) for p in (a, b))
    total = 0.0
    for x1, y1, x2, y2 in a:
        lo = np.maximum(min(x1, x2), np.minimum(b[:, 0], b[:, 2]))
        hi = np.minimum(max(x1, x2), np.maximum(b[:, 0], b[:, 2]))
        keep = lo < hi
        lo, hi, e = lo[keep], hi[keep], b[keep]
        line = lambda x, p: p[1] + (x - p[0]) * (p[3] - p[1]) / (p[2] - p[0])
        al, ah = line(lo, (x1, y1, x2, y2)), line(hi, (x1, y1, x2, y2))
        bl, bh = line(lo, e.T), line(hi, e.T)
        dl, dh = al - bl, ah - bh
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(dl * dh < 0, dl / (dl - dh), 0)
        m = al + t * (ah - al)
        area = (hi - lo) * np.where(dl * dh < 0, t * (np.minimum(al, bl) + m) + (1 - t) * (m + np.minimum(ah, bh)), np.minimum(al, bl) + np.minimum(ah, bh)) / 2
        total += (np.sign(x1 - x2) * np.sign(e[:, 0] - e[:, 2]) * area).sum()
    return total


def inside(x, y, edges):
    e = np.array([q for _, q in edges])
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    return (((e[:, 1] > y) != (e[:, 3] > y)) & right).sum() % 2 == 1


def test_overlay_of_many_vertices_is_linear_in_edges(spark):
    counts = {}
    for n in (500, 5000):
        a, b = {"A": holed(n, 0, 0, 1)}, {"B": holed(n, 35, 20, 7)}
        left, right = table(spark, a, "k"), table(spark, b, "z")
        got = {(r.k, r.z): r.area for r in G.overlap_area(left, right, "k", "z", 50.0).collect()}
        assert got == {("A", "B"): pytest.approx(shared_area(a["A"], b["B"]), rel=1e-9)}
        counts[n] = G.edge_pairs(left, right, "k", "z", 50.0).count()
    # A stripe is crossed several times, but ten times the edges make about ten times the rows.
    assert counts[5000] < 14 * counts[500]
    assert counts[5000] < 40 * 20_000 < 10_000 * 10_000 / 100


def test_overlay_does_not_depend_on_the_tile(spark):
    polygons = {f"P{i}": holed(30, 60 * i, 15 * i, i) for i in range(4)}
    zones = {f"Z{i}": holed(200, 55 * i + 20, 10, 40 + i) for i in range(4)} | {"far": holed(10, 9000, 0, 3)}
    want = {(k, z): shared_area(a, b) for k, a in polygons.items() for z, b in zones.items()}
    want = {k: pytest.approx(v, rel=1e-9, abs=1e-6) for k, v in want.items() if v > 1e-6}
    for tile in (7.0, 60.0, 5000.0):
        got = G.overlap_area(table(spark, polygons, "k"), table(spark, zones, "z"), "k", "z", tile).collect()
        assert {(r.k, r.z): r.area for r in got} == want


def test_points_meet_few_edges_however_many_a_ring_has(spark):
    rng = random.Random(2)
    where = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(600)]
    points = spark.createDataFrame(where, "p int, x double, y double")
    per_point = {}
    for n in (500, 5000):
        a = {"A": holed(n, 0, 0, 1), "B": holed(n, 60, 10, 5)}
        edges = table(spark, a, "k")
        got = {(r.p, r.k) for r in G.point_polygon_pairs(points, edges, "p", "k", 64.0).collect()}
        assert got == {(i, k) for i, x, y in where for k, e in a.items() if inside(x, y, e)}
        near = G._in_cells(points, edges, "p", "k", 64.0, [])
        border = near.where("border").select("p", "k", "stripe", "border", "x", "y")
        sure = near.where("not border").count()
        assert sure > 0.6 * len(got)
        per_point[n] = G.edges_at_height(border, edges, "k", 64.0, []).count() / max(border.count(), 1)
    assert per_point[5000] < 1.5 * per_point[500] + 5


def test_cells_of_a_polygon_with_a_hole(spark):
    def square(a, b, parts=16):
        corners = [(a, a), (b, a), (b, b), (a, b)]
        along = lambda p, q, t: (p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)
        return [along(p, q, k / parts) for p, q in zip(corners, corners[1:] + corners[:1], strict=True) for k in range(parts)]

    polygon = [(0, e) for e in ring_edges(square(0.0, 64.0))] + [(1, e) for e in ring_edges(square(24.0, 40.0)[::-1])]
    cells = {(r.gx, r.gy): (r.border, r.level) for r in G.classify_cells(table(spark, {"A": polygon}, "k"), "k", 16.0).collect()}
    side = 16.0 * 2 ** next(iter(cells.values()))[1]
    for (gx, gy), (border, _) in cells.items():
        if not border:
            x, y = (gx + 0.5) * side, (gy + 0.5) * side
            assert inside(x, y, polygon)
    assert any(not b for b, _ in cells.values())
    # What is no cell is outside.
    grid = [(i, j) for i in range(-1, int(64 / side) + 2) for j in range(-1, int(64 / side) + 2)]
    assert not any(inside((i + 0.5) * side, (j + 0.5) * side, polygon) for i, j in grid if (i, j) not in cells)


def places(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} int, x double, y double")


@pytest.mark.parametrize("shape", ["even", "clusters", "line", "one", "same"])
def test_nearest_equals_brute_force(spark, shape):
    rng = random.Random(3)
    spots = {
        "even": [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(700)],
        "clusters": [(rng.gauss(c, 0.01), rng.gauss(c * c, 0.01)) for c in (0, 3, 500) for _ in range(250)],
        "line": [(float(i), 5.0) for i in range(300)],
        "one": [(7.0, 8.0)],
        "same": [(1.0, 1.0)] * 40,
    }[shape]
    b = [(1000 - i, x, y) for i, (x, y) in enumerate(spots)]
    a = [(i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(60)] + [(100 + i, x + 0.25, y) for i, (x, y) in enumerate(spots[:40])]
    a += [(200, 4.5, 5.0), (201, None, 1.0)]
    want = sorted((i, *min((math.hypot(x - p, y - q), k) for k, p, q in b)[::-1]) for i, x, y in a if x is not None)
    got = sorted(tuple(r) for r in G.nearest(places(spark, a, "i"), places(spark, b, "k"), "i", "k").collect())
    assert [(i, round(d, 9)) for i, _, d in got] == [(i, round(d, 9)) for i, _, d in want]
    at = {k: (x, y) for k, x, y in b}
    for (i, k, d), (_, least, _) in zip(got, want, strict=True):
        # Keys agree but where two distances differ by rounding alone.
        assert k == least or at[k] != at[least]
    assert G.nearest(places(spark, a, "i"), places(spark, [], "k"), "i", "k").count() == 0


def test_building_nearest_starts_no_job(spark):
    spark.sparkContext.setJobGroup("plan only", "")
    a = spark.range(100).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    plan = G.nearest(a, a.withColumnRenamed("i", "k"), "i", "k")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan only")
    assert plan.count() == 100
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_points_of_a_border_are_in_no_polygon(spark):
    # A square, a triangle with a slanting side, and a level edge through no stripe's border.
    corners = {"S": [(125.0, 125.0), (185.0, 125.0), (185.0, 175.0), (125.0, 175.0)], "T": [(300.0, 100.0), (340.0, 100.0), (300.0, 140.0)]}
    rings = [(k, (x1, y1), p[(i + 1) % len(p)]) for k, p in corners.items() for i, (x1, y1) in enumerate(p)]
    edges = spark.createDataFrame([(k, 0, *a, *b) for k, a, b in rings], "k string, ring int, x1 double, y1 double, x2 double, y2 double")
    rim = [*corners["S"], *corners["T"], (125.0, 150.0), (185.0, 150.0), (150.0, 125.0), (150.0, 175.0), (320.0, 120.0), (320.0, 100.0)]
    within = [(125.001, 125.001), (184.999, 174.999), (310.0, 110.0), (319.999, 120.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rim + within)], "p int, x double, y double")
    want = {len(rim) + i: k for i, k in enumerate("SSTT")}
    for tile in (7.0, 64.0, 1000.0):
        assert {r.p: r.k for r in G.points_in_polygons(points, edges, "p", "k", tile).collect()} == want
    # The same points in degrees, on edges moved into the projection's zone.
    moved = edges.withColumns({c: F.col(c) + by for c, by in (("x1", 600000.0), ("x2", 600000.0), ("y1", 6600000.0), ("y2", 6600000.0))})
    lon, lat = X.from_lambert93(F.col("x") + 600000.0, F.col("y") + 6600000.0)
    assert {r.p: r.k for r in serve.locate(points.select("p", lon.alias("lon"), lat.alias("lat")), moved, "p", "k", 64.0).collect()} == want
