import math
import random

from orrery.operators.spatial import EARTH_KM, near_classes, near_pairs, parse_wkt, points_in_areas, triangulate


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))


def test_near_against_all_pairs(spark):
    rnd = random.Random(3)
    centers = [(0.01, 179.999), (0.01, -179.999), (89.995, 10), (89.996, -170), (-89.999, 5), (45, 45), (60, -120)]
    pts = [(a + rnd.uniform(-0.02, 0.02), b + rnd.uniform(-0.02, 0.02)) for a, b in centers for _ in range(40)]
    pts = [(a, b) for a, b in pts if abs(a) <= 90 and abs(b) <= 180] + [(45.0, 45.0)] * 3
    rows = [(i, *p, "x") for i, p in enumerate(pts)] + [(1000, None, 1.0, "x"), (1001, 91.0, 1.0, "x"), (1002, 0.0, 0.0, "x"), (1003, 0.0, 0.0, "x"), (1004, float("nan"), 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, row string")
    want = {(i, j) for i, a in enumerate(pts) for j, b in enumerate(pts) if i < j and km(a, b) <= 1}
    assert {tuple(r) for r in near_pairs(df, "id").collect()} == want
    members, pairs = near_classes(df, "id")
    assert members.count() == len(pts) and near_pairs(df.limit(0), "id").count() == 0
    assert pairs.count() <= len(want)


def test_triangles_cover_a_polygon_with_a_hole():
    rings = parse_wkt("POLYGON ((0 0, 10 0, 10 10, 5 4, 0 10, 0 0), (4 1, 6 1, 6 3, 4 3, 4 1))")[0]
    area = sum(((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in triangulate(rings))
    assert abs(area - (70 - 4)) < 1e-9


def test_points_in_areas(spark):
    wkt = "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 0, 30 0, 25 8, 20 0)))"
    areas = spark.createDataFrame([(1, wkt), (2, None), (3, ""), (4, "POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))")], "area_id long, wkt string")
    pts = [(1, 5.0, 2.0), (2, 5.0, 5.0), (3, 1.0, 25.0), (4, 7.0, 7.0), (5, None, 1.0), (6, 5.0, 2.0), (7, 50.0, 50.0), (8, 2.0, 2.0)]
    df = spark.createDataFrame(pts, "id long, latitude double, longitude double")
    got = {tuple(r) for r in points_in_areas(df, areas, "id").collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (1, 6), (1, 8), (4, 2), (4, 4)}
    assert points_in_areas(df.limit(0), areas, "id").count() == 0
    assert points_in_areas(df, areas.limit(0), "id").count() == 0


def test_many_areas_meet_points_by_cell(spark, monkeypatch):
    from orrery.operators import spatial

    monkeypatch.setattr(spatial, "BROADCAST_WKT", 0)
    areas = spark.createDataFrame([(1, "POLYGON ((0.5 0.5, 9 0.5, 9 9, 0.5 9, 0.5 0.5))")], "area_id long, wkt string")
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 9.5, 5.0), (3, 5.0, 0.6)], "id long, latitude double, longitude double")
    assert {tuple(r) for r in points_in_areas(df, areas, "id").collect()} == {(1, 1), (1, 3)}
