"""Operators on hand-computable inputs, with the numbers they must give."""

import datetime as dt
import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geopressure.functions import exprs as X
from geopressure.operators import allocate, attach, calibrate, checks, geometry, panel, transactions
from geopressure.plans import catalog, marts, serve

D = dt.date


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def rect(spark, key, rows):
    rows = [(k, b, *map(float, box)) for k, b, *box in rows]
    df = spark.createDataFrame(rows, f"{key} string, block string, a double, b double, c double, d double")
    return geometry.rectangles_to_edges(df, [key, "block"], "a", "b", "c", "d")


# panels


@pytest.fixture(scope="module")
def moisture(spark):
    rows = [(1, D(2000 + i, 1, 1), v) for i, v in enumerate((0.2, 0.4, 0.6))]
    rows += [(1, D(2000 + i, 7, 1), 0.5) for i in range(3)] + [(2, D(2000 + i, 1, 1), v) for i, v in enumerate((0.1, 0.1, 0.4))]
    return spark.createDataFrame(rows, "cell int, month date, swi double")


def test_climatology_and_anomaly(spark, moisture):
    clim = {(r.cell, r.calendar_month): r for r in panel.climatology(moisture, "cell", "month", "swi").collect()}
    assert (round(clim[1, 1]["mean"], 9), round(clim[1, 1]["sd"], 9), clim[1, 1]["n"]) == (0.4, 0.2, 3)
    z = {(r.cell, r.month): r.z for r in panel.seasonal_anomaly(moisture, "cell", "month", "swi").collect()}
    assert round(z[1, D(2000, 1, 1)], 9) == -1 and round(z[1, D(2002, 1, 1)], 9) == 1 and z[1, D(2000, 7, 1)] is None
    stored = panel.climatology(moisture, "cell", "month", "swi")
    again = {(r.cell, r.month): r.z for r in panel.anomaly_against(moisture, stored, "cell", "month", "swi").collect()}
    assert all((a is None) == (z[k] is None) and (a is None or abs(a - z[k]) < 1e-12) for k, a in again.items())
    assert panel.seasonal_anomaly(moisture, "cell", "month", "swi", "2002-01-01").count() == 3


def test_normal_score(spark):
    rows = [("S1", D(y, m, 1), -50.0 if (y, m) == (2022, 8) else 100 + 2.0 * m + 0.3 * (y - 2005)) for y in range(2005, 2025) for m in range(1, 13)]
    rows += [("S2", D(y, 1, 1), float(y)) for y in range(2005, 2015)]
    out = panel.normal_score(spark.createDataFrame(rows, "s string, month date, v double"), "s", "month", "v")
    got = {(r.s, r.month): r for r in out.collect()}
    dry = got["S1", D(2022, 8, 1)]
    assert dry.n == 20 and dry.z < 0 and dry.index_class in (0, 1)
    assert all(r.z is None and r.nqt is None and r.index_class is None for (s, _), r in got.items() if s == "S2")
    nqt = sorted(r.nqt for (s, m), r in got.items() if s == "S1" and m.month == 3)
    assert abs(nqt[0] + nqt[-1]) < 1e-6 and nqt == sorted(set(nqt))


def test_latest_spine_matrix_and_pivots(spark):
    rows = [("A", D(2024, 1, 1), 10, 1.0), ("A", D(2024, 3, 1), 300, 1.0), ("B", D(2024, 1, 1), None, 0.0), ("B", D(2024, 2, 1), 5, 0.0)]
    df = spark.createDataFrame(rows, "k string, month date, score int, e double")
    assert [r.month for r in panel.month_spine(df, "month").orderBy("month").collect()] == [D(2024, m, 1) for m in (1, 2, 3)]
    matrix = {r.k: (r.exposed, list(r.scores)) for r in panel.score_matrix(df, "k", "month", "score", "e").collect()}
    assert matrix == {"A": (True, [10, 0, 255]), "B": (False, [0, 5, 0])}
    assert values(panel.latest_value(df, "k", "month", "score"), "k", "score") == [("A", 300), ("B", 5)]
    assert values(panel.latest_row(df, "k", "month"), "k", "score") == [("A", 300), ("B", 5)]
    assert values(panel.latest_period(df, "month"), "k", "score") == [("A", 300)]
    wide = panel.pivot_months(df, "k", "month", {"s": "score"}, ["202401", "202403"])
    assert values(wide, "k", "s_202401", "s_202403") == [("A", 10, 300), ("B", None, None)]
    assert panel.month_spine(df.limit(0), "month").count() == 0


def test_levels_use_pooled_quantiles_and_fall_back(spark):
    df = spark.createDataFrame([(i, i * 10, 1.0) for i in range(1, 11)] + [(99, 0, 0.0)], "k int, score int, e double")
    got = {r.k: (r.level_code, r.level) for r in panel.quantile_levels(df, "score", "e").collect()}
    assert got[1] == (1, "very low") and got[10] == (5, "very high") and got[99] == (None, None)
    only = panel.quantile_levels(df.where("e = 0"), "score", "e").collect()
    assert [r.level_code for r in only] == [None]


def test_histories(spark):
    df = spark.createDataFrame([("a", D(1980, 1, 1)), ("a", D(2000, 1, 1)), ("a", D(2020, 1, 1)), ("b", D(2010, 1, 1)), ("b", D(2011, 1, 1))], "k string, d date")
    assert values(panel.cap_history(df, "k", "d", 35), "k", "d") == [("a", D(2000, 1, 1)), ("a", D(2020, 1, 1)), ("b", D(2010, 1, 1)), ("b", D(2011, 1, 1))]
    assert values(panel.eligible_series(df, "k", "d", 15, "2017-01-01"), "k") == [("a",)]
    covered = spark.createDataFrame([("a", D(2000, 1, 1))], "k string, covered_to date")
    assert values(panel.append_new(df, covered, "k", "d"), "k", "d") == [("a", D(2020, 1, 1)), ("b", D(2010, 1, 1)), ("b", D(2011, 1, 1))]


# expressions


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_scalar_formulas(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark,
        e1=X.exposure(F.lit(0.5), n), e2=X.exposure(F.lit(0.0), F.lit(1.0)), e3=X.exposure(F.lit(0.5), F.lit(0.5)), e4=X.exposure(n, n),
        d=X.dryness(F.lit(0.0)), b1=X.blend(F.lit(0.4), n, F.lit(0.5)), b2=X.blend(F.lit(0.4), F.lit(0.8), F.lit(0.5)),
        s1=X.pressure_score(F.lit(1.0), F.lit(1.0)), s2=X.pressure_score(F.lit(0.445), F.lit(1.0)), s3=X.pressure_score(F.lit(1.0), n),
        c1=X.confidence(F.lit(14.9)), c2=X.confidence(F.lit(15.0)), c3=X.confidence(F.lit(30.0)), c4=X.confidence(F.lit(22.5)),
        k=X.index_class(F.lit(-1.282)), k2=X.index_class(F.lit(2.0)), v=X.exposed_value(F.lit(2.0), n, F.lit(3.0)),
    )
    assert (r.e1, r.e2, r.e4, r.d, r.b1, r.s1, r.s2, r.s3, r.c1, r.k, r.k2, r.v) == (0.5, 0, 0, 0.5, 0.4, 100, 45, None, 0, 0, 6, None)
    assert [round(x, 9) for x in (r.e3, r.b2, r.c2, r.c3, r.c4)] == [0.5, round(0.8 / 1.5, 9), 0.4, 1.0, 0.7]


def test_probit(spark):
    from statistics import NormalDist

    for r in spark.range(1, 100).select((F.col("id") / 100).alias("p"), X.probit(F.col("id") / 100).alias("q")).collect():
        assert abs(r.q - NormalDist().inv_cdf(r.p)) < 1e-6
    r = one(spark, lo=X.probit(F.lit(0.0)), hi=X.probit(F.lit(1.0)), nil=X.probit(F.lit(None).cast("double")))
    assert -6.1 < r.lo < -5.9 < 5.9 < r.hi < 6.1 and r.nil is None


def test_codes_and_text(spark):
    r = one(
        spark,
        a=X.dept_of(F.lit("97411")), b=X.dept_of(F.lit("2A004")), c=X.dept_of(F.lit("01053")), d=X.rollup_code(F.lit("75101")),
        e=X.rollup_code(F.lit("31555")), f=X.eq_fold(F.lit("SÉCHERESSE"), "secheresse"), g=X.fold(F.lit("  St-Étienne d’Œuf ")),
        h=X.safe_cast(F.lit("12.7"), "long"), i=X.safe_cast(F.lit("x"), "int"), j=X.blank_to_null(F.lit("  ")),
        k=X.unsuppress(F.lit("secret"), "secret"), l=X.clamp(F.lit(None).cast("double"), 0, 1), m=X.safe_div(F.lit(1.0), F.lit(0.0)),
        n=X.bivariate(F.lit(3), F.lit(2)), o=X.bivariate(F.lit(0), F.lit(2)), p=X.exposure_bin(F.lit(0.25)), q=X.tension_bin(F.lit(0.39)),
        s=X.bin_by(F.lit(0.5), (0.5, 1.0), ("a", "b", "c")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("974", "2A", "01", "75056", "31555", True, "saint etienne d œuf")
    assert (r.h, r.i, r.j, r.k, r.l, r.m, r.n, r.o, r.p, r.q, r.s) == (13, None, None, None, None, None, 8, 0, 2, 1, "a")


def test_projection(spark):
    x, y = X.to_lambert93(F.lit(3.0), F.lit(46.5))
    lon, lat = X.from_lambert93(F.lit(573500.0), F.lit(6278500.0))
    r = one(spark, x=x, y=y, lon=lon, lat=lat)
    assert abs(r.x - 700000) < 1e-3 and abs(r.y - 6600000) < 1e-3 and abs(r.lon - 1.4339) < 1e-4 and abs(r.lat - 43.5943) < 1e-4


# geometry


def test_overlap_weights_and_nearest(spark):
    polygons = rect(spark, "k", [("A", "x", 3000, 3000, 5000, 5000), ("B", "x", 7000, 3000, 9000, 5000), ("C", "x", 90000, 0, 91000, 1000)]).drop("block")
    grid = spark.createDataFrame([(1, 4000.0, 4000.0), (2, 12000.0, 4000.0)], "cell int, x double, y double")
    w = geometry.cell_weights(polygons, grid, "k", "cell", 4000.0)
    assert [(k, c, round(v)) for k, c, v in values(w, "k", "cell", "weight")] == [("A", 1, 4000000), ("B", 1, 2000000), ("B", 2, 2000000), ("C", 2, 1)]
    z = spark.createDataFrame([(1, D(2020, 1, 1), -2.0), (2, D(2020, 1, 1), 2.0)], "cell int, month date, z double")
    assert values(attach.areal_mean(z, w, "cell", "k", "month", "z"), "k", "z", "n") == [("A", -2.0, 1), ("B", 0.0, 2), ("C", 2.0, 1)]


def test_zone_shares(spark):
    polygons = rect(spark, "k", [("A", "01", 0, 0, 1000, 1000), ("B", "01", 5000, 0, 6000, 1000), ("C", "02", 0, 0, 1000, 1000)])
    zones = spark.createDataFrame([("m", "01", 2, 0.0, 0.0, 500.0, 1000.0), ("h", "01", 3, 500.0, 0.0, 1000.0, 400.0)], "z string, block string, level int, a double, b double, c double, d double")
    edges = geometry.rectangles_to_edges(zones, ["z", "block", "level"], "a", "b", "c", "d")
    got = {r.k: r for r in geometry.zone_shares(polygons, edges, "k", "z", "level", "block", 700.0).collect()}
    assert [round(got["A"][c], 9) for c in ("share_medium", "share_high", "share_medium_high")] == [0.5, 0.2, 0.7]
    assert (got["A"].dominant, got["B"].dominant, got["C"].dominant, got["C"].covered) == ("medium", "none", None, False)


def test_rings_holes_and_orientation(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [("A", [ring((0, 0), (0, 10), (10, 10), (10, 0)), ring((2, 2), (2, 4), (4, 4), (4, 2), (2, 2))])]
    df = spark.createDataFrame(rows, "k string, rings array<array<struct<x:double,y:double>>>")
    edges = geometry.oriented(geometry.rings_to_edges(df, ["k"], "rings"), ["k"])
    assert values(geometry.polygon_area(edges, ["k"]), "k", "area") == [("A", 96.0)]
    assert values(geometry.polygon_area(geometry.exterior(edges), ["k"]), "k", "area") == [("A", 100.0)]
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 5.0, 5.0), (3, 20.0, 1.0)], "p int, x double, y double")
    assert values(geometry.points_in_polygons(points, edges, "p", "k", 3.0), "p", "k") == [(2, "A")]
    box = geometry.rectangles_to_edges(spark.createDataFrame([("Z", 1.0, 1.0, 5.0, 5.0)], "z string, a double, b double, c double, d double"), ["z"], "a", "b", "c", "d")
    assert [round(r.area, 6) for r in geometry.overlap_area(edges, box, "k", "z", 3.0).collect()] == [12.0]


def clipped(poly, x0, y0, x1, y1):
    """Area of a polygon within a box, by clipping against its four sides."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            a, b = keep * (p[axis] - bound), keep * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        poly = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True))) / 2 if poly else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 359), st.floats(50, 400)), min_size=4, max_size=9, unique_by=lambda t: t[0]))
def test_overlap_equals_clipping(spark, corners):
    pts = [(1000 + r * math.cos(math.radians(a)), 1000 + r * math.sin(math.radians(a))) for a, r in sorted(corners)]
    df = spark.createDataFrame([("A", [pts])], "k string, rings array<array<struct<x:double,y:double>>>")
    edges = geometry.oriented(geometry.rings_to_edges(df, ["k"], "rings"), ["k"])
    box = geometry.rectangles_to_edges(spark.createDataFrame([("Z", 900.0, 950.0, 1250.0, 1200.0)], "z string, a double, b double, c double, d double"), ["z"], "a", "b", "c", "d")
    got = sum(r.area for r in geometry.overlap_area(edges, box, "k", "z", 200.0).collect())
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(pts, pts[1:] + pts[:1], strict=True))) / 2
    star = max(b - a for a, b in zip(sorted(a for a, _ in corners), [*sorted(a for a, _ in corners)[1:], sorted(a for a, _ in corners)[0] + 360], strict=True)) < 180
    if star and area > 1:
        assert abs(got - clipped(pts, 900.0, 950.0, 1250.0, 1200.0)) < 1e-3


def test_attachment_cascade_and_radius(spark):
    polygons = rect(spark, "k", [("C1", "d", 0, 0, 1000, 1000), ("C2", "d", 3000, 0, 4000, 1000)])
    entities = spark.createDataFrame([("d", "C1", 500.0, 500.0), ("d", "C2", 3500.0, 500.0), ("d", "CN", 500.0, 7500.0), ("d", "CF", 500.0, 25500.0)], "block string, k string, x double, y double")
    stations = spark.createDataFrame([("d", "S1", "zz", 500.0, 500.0), ("d", "S3", "C2", 9e6, 9e6), ("d", "S4", "zz", 8e6, 8e6)], "block string, s string, key_hint string, x double, y double")
    out = attach.attach_cascade(stations, polygons, entities, "s", "k", 10000.0, 2000.0, "block")
    assert [(s, k, round(f, 9), m) for s, k, f, m in values(out, "s", "k", "factor", "method")] == [
        ("S1", "C1", 1.0, "inside"), ("S1", "CN", 0.3, "radius"), ("S3", "C2", 1.0, "key"),
    ]
    series = spark.createDataFrame([("S1", D(2020, 1, 1), -1.0, -1.0), ("S3", D(2020, 1, 1), -0.5, None)], "s string, month date, z double, nqt double")
    years = spark.createDataFrame([("S1", 30.0), ("S3", 30.0)], "s string, years double")
    got = attach.entity_index(series, out, "s", "k", "month", years)
    assert [(k, z, round(c, 9), n) for k, z, c, n in values(got, "k", "z", "confidence", "n_stations")] == [("C1", -1.0, 1.0, 1), ("C2", -0.5, 1.0, 1), ("CN", -1.0, 0.3, 1)]


# events


def test_order_profile_and_severity(spark):
    rows = [("31555", "o1", D(2018, 1, 1), D(2018, 3, 1)), ("31555", "o1", D(2018, 2, 1), D(2018, 4, 1)), ("31555", "o2", D(2003, 12, 1), D(2003, 12, 31))]
    orders = spark.createDataFrame(rows, "k string, o string, a date, b date")
    got = calibrate.order_profile(orders, "k", "o", "a", "b").first()
    assert (got.freq, got.first, got.last, list(got.years), len(got.events)) == (2, D(2003, 12, 1), D(2018, 1, 1), [2003, 2018], 2)
    assert got.events[1].end == D(2018, 4, 1)
    z = spark.createDataFrame([("A", D(2000, 3, 1), -3.0), ("A", D(2002, 8, 1), -1.0)], "k string, month date, z double")
    event = spark.createDataFrame([("A", "e", D(2000, 1, 1), D(2003, 6, 30)), ("B", "f", D(2000, 1, 1), D(2001, 1, 1))], "k string, order_id string, start date, end date")
    assert values(calibrate.peak_severity(event, z, "k", "month", "z", 24), "order_id", "severity") == [("e", 1.0)]
    assert values(calibrate.peak_severity(event, z, "k", "month", "z", 120), "order_id", "severity") == [("e", 3.0)]


def ecdf(spark, events, points, least):
    e = spark.createDataFrame(events, "pool string, severity double")
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "i int, pool string, s double")
    return [(None if r.h is None else round(r.h, 9), r.n_events, r.pool_level) for r in calibrate.pooled_ecdf(p, e, "pool", least).orderBy("i").collect()]


def test_pooled_distribution(spark):
    events = [("31", 2.0), ("31", 1.0), ("31", 3.0), ("09", 0.5)]
    points = [("31", 3.5), ("31", -1.0), ("31", 2.5), ("31", 2.0), ("09", 1.5), ("75", 9.0), ("31", None)]
    third = round(2 / 3, 9)
    assert ecdf(spark, events, points, 3) == [(1.0, 3, "31"), (0.0, 3, "31"), (third, 3, "31"), (third, 3, "31"), (0.5, 4, "NAT"), (1.0, 4, "NAT")]
    assert ecdf(spark, [("x", None)], [("75", 1.0)], 3) == [(None, 0, "NAT")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-4, 4).map(lambda v: round(v, 2)), min_size=1, max_size=20), st.lists(st.floats(-5, 5).map(lambda v: round(v, 2)), min_size=1, max_size=10))
def test_pooled_distribution_counts(spark, severities, asked):
    got = ecdf(spark, [("a", s) for s in severities], [("a", s) for s in asked], 1)
    assert [h for h, _, _ in got] == [round(sum(e <= s for e in severities) / len(severities), 9) for s in asked]


# allocation, transactions, marts


def test_downscale_conserves(spark):
    members = spark.createDataFrame([("a", "g", 80.0, 0.5), ("b", "g", 20.0, 1.0), ("c", "h", 5.0, 1.0), ("d", "z", 0.0, 1.0)], "k string, g string, houses double, share double")
    groups = spark.createDataFrame([("g", 100.0, False), ("z", 7.0, True)], "g string, exposed double, suppressed boolean")
    periods = spark.createDataFrame([("g", "<1919", 30.0), ("g", ">1990", 70.0), ("z", ">1990", 5.0)], "g string, period string, houses double")
    got = {r.k: r for r in allocate.downscale(members, groups, periods, "k", "g").collect()}
    assert [round(got[k].n_exposed, 2) for k in "ab"] == [66.67, 33.33] and got["c"].n_exposed is None and got["d"].n_exposed == 0.0
    assert got["a"].vulnerable_share == 0.3 and got["d"].vulnerable_share is None and got["d"].suppressed is True


def test_prices(spark):
    rows = [
        ("C", "M1", "2024-01-10", 180000.0, "H", 90.0), ("C", "M2", "2024-02-01", 300000.0, "H", 90.0), ("C", "M2", "2024-02-01", 300000.0, "F", 40.0),
        ("C", "M3", "2024-03-01", 9e7, "H", 80.0), ("C", "M4", "2025-06-01", 180000.0, "H", 90.0), ("C", "M4", "2025-06-01", 180000.0, "D", None),
        ("C", "M5", "2024-04-01", 200000.0, "H", 50.0), ("C", "M5", "2024-04-01", 200000.0, "H", 50.0),
    ]
    lines = spark.createDataFrame(rows, "c string, m string, d string, v double, t string, s double")
    out = transactions.price_profile(lines, ["c", "m"], "c", "v", "d", F.col("t") == "H", F.col("t") == "F", "s").first()
    assert (out.median_price, out.median_surface, out.n, out.n_recent, out.first_year, out.last_year) == (2000.0, 90.0, 2, 1, 2024, 2025)


def mart_inputs(spark):
    z = spark.createDataFrame([(k, D(2024, m, 1), v) for k in "XZ" for m, v in ((1, 2.0), (2, 0.0), (3, -2.0))], "k string, month date, z double")
    return z, spark.createDataFrame([("X", 0.8), ("Z", 0.0)], "k string, e double")


def test_monthly_mart(spark):
    z, e = mart_inputs(spark)
    got = {(r.k, r.month.month): r for r in marts.monthly_mart(z, e, "k", "month").collect()}
    assert got["X", 1].score < got["X", 2].score < got["X", 3].score and got["Z", 3].score == 0 and got["Z", 3].level_code is None
    assert got["X", 1].h is None and got["X", 1].groundwater_class is None
    h = spark.createDataFrame([("X", D(2024, 3, 1), 0.7), ("Z", D(2024, 3, 1), 0.9)], "k string, month date, h double")
    g = spark.createDataFrame([("X", D(2024, 3, 1), -2.0, -1.5, 1.0)], "k string, month date, z_b double, nqt double, confidence double")
    got = {(r.k, r.month.month): r for r in marts.monthly_mart(z, e, "k", "month", g, h).collect()}
    assert got["X", 3].h == 0.7 and got["Z", 3].h is None and got["X", 3].groundwater_class == 0
    assert round(got["X", 3].confidence_t, 9) == round(0.5 / 1.5, 9)


def test_static_mart_with_and_without_inputs(spark):
    entities = spark.createDataFrame([("A", "a"), ("B", "b")], "k string, name string")
    shares = spark.createDataFrame([("A", 0.5), ("B", 0.0)], "k string, share double")
    bare = {r.k: r for r in marts.static_mart(entities, shares, None, None, None, None, None, "k", "month").collect()}
    assert bare["A"].e == 0.5 and bare["B"].e == 0 and bare["A"].exposed_value is None and bare["A"].reclassified is False and list(bare["A"].years) == []
    stock = spark.createDataFrame([("A", 0.5, 100.0)], "k string, vulnerable_share double, n_exposed double")
    prices = spark.createDataFrame([("A", 2000.0, 90.0)], "k string, median_price double, median_surface double")
    rows = [("A", D(2024, 1, 1), 10, 1, 0.1), ("A", D(2024, 2, 1), 60, 4, 0.8)]
    monthly = spark.createDataFrame(rows, "k string, month date, score int, level_code int, t double")
    full = {r.k: r for r in marts.static_mart(entities, shares, stock, prices, None, None, monthly, "k", "month").collect()}
    assert full["A"].exposed_value == 18_000_000.0 and full["B"].exposed_value is None
    assert (full["A"].month, full["A"].score, full["B"].score) == (D(2024, 2, 1), 60, None)


def test_lookups_and_search(spark):
    static = spark.createDataFrame([("75056", "Paris"), ("31555", "Toulouse"), ("33063", "Bordeaux")], "k string, name string")
    rows = [("75056", D(2024, 7, 1), 3), ("75056", D(2024, 8, 1), 4), ("31555", D(2024, 8, 1), 1)]
    levels = spark.createDataFrame(rows, "k string, month date, level_code int")
    card = {r.k: (r.month, r.level_code) for r in serve.entity_card(static, levels, "k", "month").collect()}
    assert card == {"75056": (D(2024, 8, 1), 4), "31555": (D(2024, 8, 1), 1), "33063": (None, None)}
    assert values(serve.entity_card(static, levels, "k", "month", ["75056"], "2024-07-01"), "k", "level_code") == [("75056", 3)]
    codes = spark.createDataFrame([("75101", "75001"), ("31555", "31000"), ("31555", "31000"), ("31555", "31100")], "k string, postcode string")
    index = serve.search_index(static, "k", "name", codes, levels, "month")
    assert values(index, "k", "postcodes", "level") == [("31555", ["31000", "31100"], 1), ("33063", [], 0), ("75056", ["75001"], 4)]
    asked = spark.createDataFrame([("tou",), ("75001",), ("33063",), ("bordaux",), ("zz",)], "query string")
    asked = asked.unionByName(spark.createDataFrame([("xbordeaux",), ("3110",), ("par tou",)], "query string"))
    got = values(serve.search(index, asked, "k"), "query", "k", "rank", "n_words", "n_begins")
    assert got == [
        ("3110", "31555", 3, 1, 1), ("33063", "33063", 1, 0, 0), ("75001", "75056", 2, 1, 1), ("bordaux", "33063", 3, 1, 0),
        ("par tou", "31555", 3, 1, 1), ("par tou", "75056", 3, 1, 1), ("tou", "31555", 3, 1, 1), ("xbordeaux", "33063", 3, 1, 0),
    ]


def test_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    assert values(checks.expect(df, "t", missing=F.col("v").isNull(), none=F.col("k") > 9), "check", "n_bad", "n_rows") == [("missing", 1, 2), ("none", 0, 2)]
    assert checks.orphans(df, df.where("k = 1"), "k").count() == 1
    assert checks.profile(df, ["k"], None, ["v"]).first().null_v == 1
    seen, watch = checks.observed(df, "w", missing=F.col("v").isNull())
    seen.collect()
    assert watch.get == {"n_rows": 2, "missing": 1}
    with pytest.raises(ValueError):
        checks.require_rows(df.limit(0), "panel")


def test_mart_keeps_entities_without_exposure_and_gates_calibration(spark):
    z = spark.createDataFrame([("a", D(2024, 1, 1), -1.0), ("b", D(2024, 1, 1), -1.0)], "k string, month date, z double")
    exposures = spark.createDataFrame([("a", 0.5)], "k string, e double")
    known = spark.createDataFrame([(k, D(2024, 1, 1), 0.3, 40, "31") for k in "ab"], "k string, month date, h double, n_events long, pool_level string")
    out = values(marts.monthly_mart(z, exposures, "k", "month", calibration=known), "k", "e", "h", "n_events", "pool_level")
    assert out == [("a", 0.5, 0.3, 40, "31"), ("b", 0.0, None, None, None)]


def test_entity_index_takes_stations_with_known_z_for_both_means(spark):
    panel = spark.createDataFrame([("s", D(2024, 1, 1), 1.0, 0.5), ("t", D(2024, 1, 1), None, -0.5)], "s string, month date, z double, nqt double")
    attached = spark.createDataFrame([("s", "a", 1.0), ("t", "a", 1.0)], "s string, k string, factor double")
    years = spark.createDataFrame([("s", 30.0), ("t", 30.0)], "s string, years double")
    out = values(attach.entity_index(panel, attached, "s", "k", "month", years), "k", "z", "nqt", "n_stations")
    assert out == [("a", 1.0, 0.5, 1)]


def test_blend_takes_what_is_known(spark):
    rows = spark.createDataFrame([(None, 0.4, 0.5), (0.2, None, 0.5), (0.2, 0.8, 0.5)], "a double, b double, w double")
    assert [r[0] for r in rows.select(F.round(X.blend("a", "b", "w"), 6)).collect()] == [0.4, 0.2, 0.4]


def test_fold_by_decomposition(spark):
    r = one(spark, a=X.fold(F.lit("Łódź Čačak")), b=X.fold(F.lit("E\u0301te\u0301")), c=X.fold(F.lit("ṩ Ste-Foy")), d=X.fold(F.lit("")), e=X.fold(F.lit(None).cast("string")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("łodz cacak", "ete", "s sainte foy", "", None)


def test_pooled_ecdf_at_any_number_of_slices(spark):
    rnd = random.Random(5)
    events = [(rnd.choice("abc"), rnd.choice([0.5, 1.0, rnd.gauss(0, 3), -2.0])) for _ in range(400)] + [("d", 9.0), ("a", None)]
    points = [(i, rnd.choice("abcdx"), rnd.choice([0.5, -2.0, 100.0, -100.0, rnd.gauss(0, 3), None])) for i in range(200)]
    ev = spark.createDataFrame(events, "pool string, severity double")
    pt = spark.createDataFrame(points, "i int, pool string, s double")
    known = [(p, v) for p, v in events if v is not None]
    want = {}
    for i, p, s in points:
        own = [v for q, v in known if q == p]
        used = own if len(own) >= 30 else [v for _, v in known]
        if s is not None:
            want[i] = (round(sum(v <= s for v in used) / len(used), 9), len(used), p if len(own) >= 30 else "NAT")
    for slices in (2, 7, 64):
        got = calibrate.pooled_ecdf(pt, ev, "pool", 30, slices).collect()
        assert {r.i: (round(r.h, 9), r.n_events, r.pool_level) for r in got} == want
    empty = calibrate.pooled_ecdf(pt, ev.limit(0), "pool").collect()
    assert {(r.h, r.n_events, r.pool_level) for r in empty} == {(None, 0, "NAT")}


def test_map_features_hold_polygons_in_degrees(spark):
    ring = [(700000.0, 6600000.0), (701000.0, 6600000.0), (701000.0, 6601000.0), (700000.0, 6600000.0)]
    polygons = spark.createDataFrame([("a", [ring]), ("a", [ring, ring]), ("z", [ring])], "k string, rings array<array<struct<x:double,y:double>>>")
    table = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "k string, e double")
    (row,) = marts.map_features(table, polygons, "k").collect()
    assert (row.k, row.geometry.type, [len(p) for p in row.geometry.coordinates]) == ("a", "MultiPolygon", [1, 2])
    lon, lat = row.geometry.coordinates[0][0][0]
    assert lon == 3.0 and abs(lat - 46.5) < 1e-6


def test_feature_table_needs_months(spark):
    rows = spark.createDataFrame([("a", D(2024, 2, 1), 3, 0.5, 30), ("a", D(2024, 1, 1), None, None, 10)], "k string, month date, level_code int, t double, score int")
    assert panel.months_of(rows, "month") == ["202401", "202402"]
    static = spark.createDataFrame([("a", "A", 0.31239, 10.4), ("b", "B", None, None)], "k string, name string, e double, exposed_value double")
    got = {r.k: r for r in marts.feature_table(static, rows, "k", "month", panel.months_of(rows, "month"), ["name"]).collect()}
    assert (got["a"].name, got["a"].e, got["a"].e_bin, got["a"].n_202401, got["a"].t_202401, got["a"].s_202402) == ("A", 0.3124, 2, 0, 0, 30)
    assert (got["b"].e_bin, got["b"].n_202401) == (0, None)
    with pytest.raises(ValueError):
        panel.months_of(rows.limit(0), "month")


def test_search_index_box_department_and_sink(spark, tmp_path):
    entities = spark.createDataFrame([("97411", "Saint-Denis"), ("31555", "Toulouse")], "k string, name string")
    edges = geometry.rings_to_edges(spark.createDataFrame([("31555", [[(573500.0, 6278500.0), (574500.0, 6278500.0), (574500.0, 6279500.0)]])], "k string, rings array<array<struct<x:double,y:double>>>"), ["k"], "rings")
    codes = spark.createDataFrame([("31555", ""), ("31555", "31000"), ("31555", None)], "k string, postcode string")
    levels = spark.createDataFrame([("31555", D(2024, 8, 1), 4), ("97411", D(2024, 8, 1), None)], "k string, month date, level_code int")
    index = serve.search_index(entities, "k", "name", codes, levels, "month", edges)
    serve.write_search_index(index, "k", levels, "month", str(tmp_path))
    got = {r.k: r for r in spark.read.option("basePath", f"{tmp_path}/index").parquet(f"{tmp_path}/index").collect()}
    assert (str(got["97411"].dept), got["97411"].xmin, got["97411"].level, got["97411"].postcodes) == ("974", None, 0, [])
    box = got["31555"]
    assert (box.postcodes, box.level) == (["31000"], 4) and 1.42 < box.xmin < box.xmax < 1.45 and 43.59 < box.ymin < box.ymax < 43.61
    assert values(spark.read.parquet(f"{tmp_path}/levels"), "l4", "l1") == [(1, 0)]


def test_search_index_sink_of_many_suppliers(spark, sf_dir, tmp_path):
    # Numbers that read as sub-units of a city, and one whose code is cut to another's.
    suppliers = spark.createDataFrame([(k, f"S{k}", 1, 100.0) for k in (13055, 13201, 13202, 13216, 1320100)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_suppkey", F.lit(13201).cast("long")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [(r.code, r.folded, r.dept, r.postcodes, r.level > 0) for r in catalog.QUERIES["search_index_sink"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [
        ("13055", "s13055", "13", "0,9", False), ("13201", "s13201", "13", "6,9", True), ("13201", "s1320100", "13", "5,9", False),
        ("13202", "s13202", "13", "0,9", False), ("13216", "s13216", "13", "0,9", False),
    ]


def test_metadata_row(spark):
    static = spark.createDataFrame([("a", 0.5, 10.0, True), ("b", 0.0, None, False)], "k string, e double, exposed_value double, reclassified boolean")
    panel = spark.createDataFrame([("a", D(2024, m, 1), 0.5, 10 * m) for m in range(1, 6)], "k string, month date, e double, score int")
    manifests = spark.createDataFrame([("x", D(2024, 1, 1)), ("x", D(2024, 3, 1))], "source string, fetched date")
    r = serve.metadata(static, panel, "k", "month", manifests, ["x", "y"]).first()
    assert (r.n_entities, r.n_exposed, r.n_with_value, r.total_value, r.n_reclassified, r.n_months) == (2, 1, 1, 10.0, 1, 5)
    assert (r.q1, r.q2, r.q3, r.q4) == (18.0, 26.0, 34.0, 42.0) and (r.last_updated_x, r.last_updated_y) == (D(2024, 3, 1), None)
    assert serve.metadata(static, panel.limit(0), "k", "month", manifests, ["x"]).first().q1 == 20.0


def test_named_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "k int, c string")
    nothing = df.limit(0)
    rows = checks.all_expectations(
        [
            checks.expect_one_value(df, "c", "t", "codes"), checks.expect_one_value(nothing, "c", "t", "codes0"),
            checks.expect_unique(df, ["k"], "t", "twice"), checks.expect_unique(nothing, ["k"], "t", "twice0"),
            checks.expect_some(df, F.col("c") == "z", "t", "broken"), checks.expect_some(df, F.col("c") == "a", "t", "some"),
        ]
    )
    got = {r.check: (r.n_bad, r.n_rows) for r in rows.collect()}
    assert got == {"codes": (1, 3), "codes0": (0, 0), "twice": (1, 3), "twice0": (0, 0), "broken": (3, 3), "some": (0, 3)}


def test_exact_medians_equal_sorting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), rnd.choice([rnd.gauss(0, 1), float(rnd.randrange(5))]), float(rnd.randrange(50))) for _ in range(5000)]
    rows += [("one", 2.0, None), ("two", 1.0, 4.0), ("two", 2.0, 4.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, u double, s double").repartition(7)
    want = {}
    for k in {r[0] for r in rows}:
        for i in (1, 2):
            v = [r[i] for r in rows if r[0] == k and r[i] is not None]
            want[k, i] = statistics.median(v) if v else None
    # A coarse sketch leaves more inside its bracket; the result is the same.
    for accuracy in (100, 100_000):
        got = transactions.exact_medians(df, "k", ["u", "s"], accuracy).collect()
        assert {(r.k, i): r[c] for r in got for i, c in ((1, "u"), (2, "s"))} == want
    clash = df.withColumnsRenamed({"k": "c", "u": "v", "s": "n"})
    assert {r.c: r.v for r in transactions.exact_medians(clash, "c", ["v", "n"]).collect()} == {k: m for (k, i), m in want.items() if i == 1}
