"""Points near other points, and points inside regions.

Near: positions are put on a grid of cells of about twice the distance; each distinct position stands once at its own
cell and visits the cells its circle touches, so that every pair meets in exactly one cell and the join is an equi-join.

Inside: polygons are cut into triangles by ear clipping, a bounding-volume hierarchy over the triangles gives each point
its candidates, and those are tested exactly. A point on an edge shared by triangles of one region is assigned once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import cut, sort_join, spread

EARTH_KM = 6371.0088
#: Regions are carried to every task up to this many characters of WKT; their triangles are divided among tasks beyond.
BROADCAST_WKT = 8_000_000


def valid_position(lat: Column, lon: Column) -> Column:
    """Neither null, nor NaN, nor out of range, nor the placeholder 0, 0."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def positions(points: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """(id, lat, lon) of the rows whose position counts."""
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return p.where(valid_position(F.col("lat"), F.col("lon"))).select("id", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))


def near_positions(spots: DataFrame, km: float) -> DataFrame:
    """(rep_1, rep_2) for each two of the distinct positions (rep, lat, lon) at most km apart, the smaller rep first."""
    deg = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    size = 2 * deg
    row = lambda lat: F.floor((lat + 90) / size)
    n_cols = lambda r: F.greatest(F.lit(1).cast("long"), F.floor(360 * F.cos(F.radians((r + 0.5) * size - 90)) / size))
    lat, lon = F.col("lat"), F.col("lon")
    home = spots.select(F.col("rep").alias("rep_1"), lat.alias("lat_1"), lon.alias("lon_1"), row(lat).alias("row"))
    home = home.withColumn("col", F.pmod(F.floor((F.col("lon_1") + 180) / 360 * n_cols(F.col("row"))), n_cols(F.col("row"))))
    # The circle's width in longitude; all the way round where it holds a pole.
    at_pole = F.abs(lat) + deg >= 90
    width = F.when(at_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(deg)) / F.cos(F.radians(lat))))) * (1 + 1e-9))
    visits = spots.select(F.col("rep").alias("rep_2"), lat.alias("lat_2"), lon.alias("lon_2"), width.alias("w"), F.explode(F.sequence(row(F.greatest(lat - deg, F.lit(-90.0))), row(F.least(lat + deg, F.lit(90.0))))).alias("row"))
    n = n_cols(F.col("row"))
    lo, hi = F.floor((F.col("lon_2") - F.col("w") + 180) / 360 * n), F.floor((F.col("lon_2") + F.col("w") + 180) / 360 * n)
    visits = visits.withColumn("col", F.explode(F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + n)), lambda c: F.pmod(c, n))))).drop("w")
    return sort_join(home, visits, ["row", "col"]).where("rep_1 < rep_2").where(great_circle_km(F.col("lat_1"), F.col("lon_1"), F.col("lat_2"), F.col("lon_2")) <= km).select("rep_1", "rep_2")


def near_classes(points: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude", km: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (rep, id) of the rows at each distinct position, and (rep_1, rep_2) of the positions nearby.

    The form for inputs with large groups of rows at one position, of which not all pairs are wanted."""
    p = positions(points, id_col, lat, lon)
    spots = p.groupBy("lat", "lon").agg(F.min("id").alias("rep"))
    members = sort_join(p, spots, ["lat", "lon"]).select("rep", "id")
    return members, near_positions(spots.select("rep", "lat", "lon"), km)


def near_pairs(points: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude", km: float = 1.0) -> DataFrame:
    """(id_1, id_2) for each two rows at most km apart, the smaller id first.

    Distances are measured once per two distinct positions, then spread to the rows. Rows at one position are pairs too;
    rows whose position is null, out of range or 0, 0 have none. Ids must be unique."""
    p = positions(points, id_col, lat, lon)
    spots = p.groupBy("lat", "lon").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = sort_join(p, spots, ["lat", "lon"]).select("rep", "id", "n")
    pairs = near_positions(spots.select("rep", "lat", "lon"), km)
    a, b = members.select(F.col("rep").alias("rep_1"), F.col("id").alias("a")), members.select(F.col("rep").alias("rep_2"), F.col("id").alias("b"))
    apart = sort_join(sort_join(pairs, a, "rep_1"), b, "rep_2").select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"))
    many = members.where("n > 1")
    same = sort_join(many.select("rep", F.col("id").alias("id_1")), many.select("rep", F.col("id").alias("id_2")), "rep").where("id_1 < id_2").select("id_1", "id_2")
    return apart.unionByName(same)


# Regions


def parse_wkt(wkt: str) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a POLYGON or MULTIPOLYGON, each a list of rings (the outer one first) without the closing point."""
    polygons = []
    for body in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", wkt):
        rings = []
        for ring in re.findall(r"\(([^()]*)\)", body):
            pts = [tuple(map(float, p.split()[:2])) for p in ring.split(",") if p.strip()]
            pts = [p for i, p in enumerate(pts) if i == 0 or p != pts[i - 1]]
            if len(pts) > 1 and pts[0] == pts[-1]:
                pts.pop()
            if len(pts) >= 3:
                rings.append(pts)
        if rings:
            polygons.append(rings)
    return polygons


def orient(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> int:
    """The sign of the turn a, b, c, exactly."""
    l, r = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    d = l - r
    if abs(d) > 4e-16 * (abs(l) + abs(r)) * 4:
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _area2(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def _inside(p: tuple, a: tuple, b: tuple, c: tuple) -> bool:
    """p in the closed triangle a, b, c, which turns left."""
    return orient(*a, *b, *p) >= 0 and orient(*b, *c, *p) >= 0 and orient(*c, *a, *p) >= 0


def _bridged(outer: list, holes: list[list]) -> list:
    """One ring that goes into each hole and back over a bridge."""
    ring = list(outer)
    for hole in sorted(holes, key=lambda h: -max(p[0] for p in h)):
        k = max(range(len(hole)), key=lambda i: hole[i])
        p = hole[k]
        best = None
        for i, q in enumerate(ring):
            d = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2
            if best is not None and d >= best[0]:
                continue
            every = [*zip(ring, ring[1:] + ring[:1]), *(e for h in holes for e in zip(h, h[1:] + h[:1]))]
            if not any(_cross(p, q, a, b) for a, b in every) and _opens(ring, i, p):
                best = (d, i)
        i = best[1] if best else 0
        ring = ring[: i + 1] + hole[k:] + hole[: k + 1] + ring[i:]
    return ring


def _cross(p: tuple, q: tuple, a: tuple, b: tuple) -> bool:
    """Whether the open segments p-q and a-b have a point in common that isn't an end of both."""
    if p in (a, b) or q in (a, b):
        other = b if a in (p, q) else a
        return other not in (p, q) and orient(*p, *q, *other) == 0 and min(p[0], q[0]) <= other[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= other[1] <= max(p[1], q[1])
    s, t, u, v = orient(*p, *q, *a), orient(*p, *q, *b), orient(*a, *b, *p), orient(*a, *b, *q)
    return s * t <= 0 and u * v <= 0 and not (s == t == 0)


def _opens(ring: list, i: int, p: tuple) -> bool:
    """Whether p is seen from vertex i on the ring's inner side."""
    a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
    if orient(*a, *b, *c) >= 0:
        return orient(*b, *c, *p) >= 0 and orient(*a, *b, *p) >= 0
    return not (orient(*a, *b, *p) < 0 and orient(*b, *c, *p) < 0)


def triangulate(rings: list[list[tuple[float, float]]]) -> list[tuple]:
    """Triangles (turning left) that make up the polygon, by ear clipping."""
    outer = rings[0] if _area2(rings[0]) > 0 else rings[0][::-1]
    ring = _bridged(outer, [h if _area2(h) < 0 else h[::-1] for h in rings[1:]])
    out = []
    while len(ring) > 3:
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            turn = orient(*a, *b, *c)
            if turn < 0 or (turn > 0 and any(p not in (a, b, c) and _inside(p, a, b, c) for p in ring)):
                continue
            if turn > 0:
                out.append((a, b, c))
            del ring[i]
            break
        else:
            raise ValueError("a polygon crosses itself")
    if orient(*ring[0], *ring[1], *ring[2]) > 0:
        out.append(tuple(ring))
    return out


class BoundingVolumes:
    """A binary hierarchy of boxes over triangles, in flat arrays."""

    LEAF = 8

    def __init__(self, triangles: np.ndarray):
        self.t = triangles.reshape(-1, 6)
        x, y = self.t[:, 0::2], self.t[:, 1::2]
        self.box = np.stack([x.min(1), y.min(1), x.max(1), y.max(1)], 1) if len(self.t) else np.zeros((0, 4))
        self.nodes: list[tuple[np.ndarray, int, int, np.ndarray | None]] = []
        if len(self.t):
            self._build(np.arange(len(self.t)))

    def _build(self, members: np.ndarray) -> int:
        b = self.box[members]
        at, box = len(self.nodes), np.concatenate([b[:, :2].min(0), b[:, 2:].max(0)])
        self.nodes.append((box, -1, -1, members))
        if len(members) > self.LEAF:
            axis = int(box[3] - box[1] > box[2] - box[0])
            order = members[np.argsort(b[:, axis] + b[:, axis + 2], kind="stable")]
            left, right = self._build(order[: len(order) // 2]), self._build(order[len(order) // 2 :])
            self.nodes[at] = (box, left, right, None)
        return at

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) for each point in a closed triangle, exactly."""
        points, found = [], []
        stack = [(0, np.arange(len(x)))] if self.nodes else []
        while stack:
            at, idx = stack.pop()
            box, left, right, members = self.nodes[at]
            px, py = x[idx], y[idx]
            idx = idx[(px >= box[0]) & (px <= box[2]) & (py >= box[1]) & (py <= box[3])]
            if not len(idx):
                continue
            if members is None:
                stack += [(left, idx), (right, idx)]
                continue
            for k in members:
                got = idx[self._within(k, x[idx], y[idx])]
                points.append(got)
                found.append(np.full(len(got), k))
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(points), np.concatenate(found)) if points else (none, none)

    def _within(self, k: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        t, ok = self.t[k], np.ones(len(px), dtype=bool)
        for i in range(3):
            ax, ay, bx, by = t[2 * i], t[2 * i + 1], t[(2 * i + 2) % 6], t[(2 * i + 3) % 6]
            l, r = (bx - ax) * (py - ay), (by - ay) * (px - ax)
            near = np.abs(l - r) <= 16e-16 * (np.abs(l) + np.abs(r))
            side = l - r >= 0
            for j in np.flatnonzero(near & ok):
                side[j] = orient(ax, ay, bx, by, px[j], py[j]) >= 0
            ok &= side
        return ok


def triangles_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(area_id, six coordinates) from (area_id, wkt)."""
    for pdf in batches:
        rows = [(i, *a, *b, *c) for i, wkt in zip(pdf["area_id"], pdf["wkt"]) for rings in parse_wkt(wkt) for a, b, c in triangulate(rings)]
        yield pd.DataFrame(rows, columns=["area_id", "ax", "ay", "bx", "by", "cx", "cy"])


def _assigned(triangles: pd.DataFrame) -> tuple[np.ndarray, BoundingVolumes]:
    return triangles["area_id"].to_numpy(), BoundingVolumes(triangles[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy())


def points_in_areas(points: DataFrame, areas: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude", area_id: str = "area_id", wkt: str = "wkt", carried: int | None = None) -> DataFrame:
    """(area_id, id) for each point and each area that contains it, once; points on an area's edge are inside.

    Edges are straight in longitude and latitude, holes are outside. Areas with a null, empty or unreadable WKT contain
    nothing; one that crosses itself is an error. Points without a valid position are in none; repeated rows each count.
    Areas of up to ``carried`` characters (BROADCAST_WKT) go to every task as one hierarchy; more are divided, with the same result."""
    areas = areas.select(F.col(area_id).cast("long").alias("area_id"), F.col(wkt).alias("wkt")).where("wkt is not null")
    triangles = cut(areas.mapInPandas(triangles_of, "area_id long, ax double, ay double, bx double, by double, cx double, cy double"))
    p = positions(points, id_col, lat, lon)
    if areas.agg(F.coalesce(F.sum(F.length("wkt")), F.lit(0)).alias("n")).first()["n"] > (BROADCAST_WKT if carried is None else carried):
        return _divided(p, triangles)
    volumes = p.sparkSession.sparkContext.broadcast(_assigned(triangles.toPandas()))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, tree = volumes.value
        for pdf in batches:
            at, which = tree.hits(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())
            yield pd.DataFrame({"area_id": owner[which], "id": pdf["id"].to_numpy()[at], "at": at}).drop_duplicates(["area_id", "at"])[["area_id", "id"]]

    return spread(p).mapInPandas(assign, "area_id long, id long")


def _divided(p: DataFrame, triangles: DataFrame, most_points: int = 200_000, most_triangles: int = 50_000) -> DataFrame:
    """As points_in_areas for triangles too many to carry along: the hierarchy's upper nodes are the cells of grids, each
    half as fine as the one before, and a triangle stands in the few cells it touches of the grid of its size. Points look
    into their cell of each grid that is used. Below, each cell has a hierarchy of its own, with the same exact test.

    A dense cell is divided into parts of so many points and triangles at most, which meet each other part by part."""
    key = ["level", "x", "y"]
    box = lambda f, axis: f(*(c + axis for c in "abc"))
    width = F.greatest(box(F.greatest, "x") - box(F.least, "x"), box(F.greatest, "y") - box(F.least, "y"), F.lit(2.0**-6))
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    t = triangles.withColumn("tid", F.xxhash64(*triangles.columns)).withColumn("level", F.ceil(F.log2(width)).cast("int"))
    t = t.withColumn("x", F.explode(F.sequence(cell(box(F.least, "x")), cell(box(F.greatest, "x"))))).withColumn("y", F.explode(F.sequence(cell(box(F.least, "y")), cell(box(F.greatest, "y")))))
    t = cut(t)
    levels = [r["level"] for r in t.select("level").distinct().collect()]  # from -6 to 9
    # A number of its own keeps rows with one id apart.
    q = cut(p.withColumn("row", F.monotonically_increasing_id()))
    q = q.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])) if levels else F.lit(0)).withColumn("x", cell(F.col("lon"))).withColumn("y", cell(F.col("lat")))
    n_t = t.groupBy(*key).agg(F.ceil(F.count("*") / most_triangles).cast("int").alias("t_parts"))
    n_q = sort_join(q, n_t, key, "left_semi").groupBy(*key).agg(F.ceil(F.count("*") / most_points).cast("int").alias("q_parts"))
    parts = cut(sort_join(n_t, n_q, key))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.col(n)).cast("int")
    left = sort_join(q, parts, key).withColumn("qp", own("row", "q_parts")).withColumn("tp", every("t_parts"))
    right = sort_join(t, parts, key).withColumn("tp", own("tid", "t_parts")).withColumn("qp", every("q_parts"))
    group = [*key, "qp", "tp"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"area_id": [], "id": [], "row": []}).astype("int64")
        owner, tree = _assigned(b)
        at, which = tree.hits(a["lon"].to_numpy(), a["lat"].to_numpy())
        return pd.DataFrame({"area_id": owner[which], "id": a["id"].to_numpy()[at], "row": a["row"].to_numpy()[at]}).drop_duplicates()

    met = left.select(*group, "id", "row", "lat", "lon").groupBy(*group).cogroup(right.select(*group, *triangles.columns).groupBy(*group)).applyInPandas(meet, "area_id long, id long, row long")
    return met.dropDuplicates(["area_id", "row"]).select("area_id", "id")
