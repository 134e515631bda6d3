"""Regions carried whole and regions divided among tasks give the same rows."""

import random

from orrery.operators import spatial


def test_divided_regions_give_the_same(spark):
    rnd = random.Random(4)
    squares = [(i, f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}), ({x + w / 4} {y + w / 4}, {x + w / 4} {y + w / 2}, {x + w / 2} {y + w / 2}, {x + w / 2} {y + w / 4}, {x + w / 4} {y + w / 4}))") for i, (x, y, w) in enumerate([(0, 0, 1), (0.5, 0.5, 8), (-170, -80, 150), (10, 10, 0.001), (1, 0, 1)])]
    areas = spark.createDataFrame([*squares, (9, None), (10, "")], "area_id long, wkt string")
    at = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)] + [(rnd.uniform(-1, 9), rnd.uniform(-1, 9)) for _ in range(400)]
    at += [(1.0, 0.5), (0.0, 1.0), (0.25, 0.3), (1.0, 1.0), (10.0005, 10.0), (0.0, 2.0), (None, 1.0), (0.0, 0.0)] * 2
    points = spark.createDataFrame([(i % 600, a, b) for i, (a, b) in enumerate(at)], "id long, latitude double, longitude double")
    whole = sorted(tuple(r) for r in spatial.points_in_areas(points, areas, "id").collect())
    assert len(whole) > 100
    assert sorted(tuple(r) for r in spatial.points_in_areas(points, areas, "id", carried=0).collect()) == whole
    p = spatial.positions(points, "id", "latitude", "longitude")
    triangles = areas.where("wkt is not null").mapInPandas(spatial.triangles_of, "area_id long, ax double, ay double, bx double, by double, cx double, cy double")
    assert sorted(tuple(r) for r in spatial._divided(p, triangles, 20, 2).collect()) == whole
