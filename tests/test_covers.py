"""Polygon covers against plain ray casting, and matching on cells of bounded size against plain distances."""

import math
import random

from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import areas, coverage

RING = "polygon_id bigint, ring array<struct<lat:double,lon:double>>"


def inside(ring, lat, lon):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_rings(spark):
    """Corners and points on the lines of cells, flat and upright edges, slits, a ring in one cell, a wide one, and one of 10 000 corners."""
    rng = random.Random(1)
    star = [(0.5 + r * math.sin(k * math.tau / 10_000), 0.5 + r * math.cos(k * math.tau / 10_000)) for k in range(10_000) for r in [0.2 + 0.05 * math.sin(k / 40) + rng.random() * 1e-4]]
    rings = [
        [(0.0, 0.0), (0.0, 0.06), (0.06, 0.06), (0.03, 0.03), (0.06, 0.0)],
        [(0.01, 0.01), (0.01, 0.05), (0.02, 0.05), (0.02, 0.02), (0.03, 0.02), (0.03, 0.05), (0.04, 0.05), (0.04, 0.01)],
        [(0.0, 0.0), (0.05, 0.05), (0.0, 0.05), (0.05, 0.0)],
        [(0.0121, 0.0121), (0.0121, 0.0179), (0.0179, 0.0179), (0.0179, 0.0121)],
        [(-0.035, -0.2), (0.0349, -0.1999), (0.035, 0.3), (-0.03, 0.2)],
        [(0.0, 0.0), (0.02, 0.0), (0.02, 0.03), (0.0, 0.03), (0.0, 0.0)],
        [(0.0, 0.02), (0.04, 0.02), (0.04, 0.02), (0.02, 0.04)],
        [(rng.random() * 0.1, rng.random() * 0.1) for _ in range(60)],
        star,
    ]
    points = [(k % 9 * 0.005, k // 9 * 0.005) for k in range(120)] + [(rng.uniform(-0.04, 0.1), rng.uniform(-0.2, 0.3)) for _ in range(300)] + [(rng.uniform(0.2, 0.8), rng.uniform(0.2, 0.8)) for _ in range(150)] + [rings[7][3], star[17], (0.012, 0.012)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], RING)
    p = spark.createDataFrame([(k, *q) for k, q in enumerate(points)] + [(0, *points[0])], "k bigint, lat double, lon double")
    want = sorted((n, k) for n, r in enumerate(rings) for k, q in [*enumerate(points), (0, points[0])] if inside(r, *q))
    for most in (64, 3):
        assert areas.polygon_cover(df, 0.01, most).agg(F.max(F.size("items"))).first()[0] <= most
        assert sorted(map(tuple, areas.points_in_polygons(p, df, ["k"], 0.01, most).collect())) == want


def test_matching_on_dense_cells(spark):
    """Many short segments, some on top of each other, and a long one that crosses cells it does not count in."""
    rng = random.Random(2)
    ends = []
    for _ in range(220):
        y, x, a, m = 47.65 + rng.random() ** 3 * 0.012, -117.42 + rng.random() ** 3 * 0.012, rng.random() * math.tau, rng.choice([1e-5, 3e-4, 2e-3])
        ends.append((y, x, y + m * math.sin(a), x + m * math.cos(a)))
    ends += [(47.6521, -117.4181, 47.6522, -117.418)] * 20 + [(47.64, -117.43, 47.70, -117.40)]
    points = [(47.65 + rng.random() ** 3 * 0.012, -117.42 + rng.random() ** 3 * 0.012) for _ in range(250)] + [(47.65215, -117.41805)] * 30 + [(47.67, -117.415)]

    def dist(p, e):
        kx = math.cos(math.radians(p[0])) * geo.DEGREE_M
        dx, dy, px, py = (e[3] - e[1]) * kx, (e[2] - e[0]) * geo.DEGREE_M, (p[1] - e[1]) * kx, (p[0] - e[0]) * geo.DEGREE_M
        t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - t * dx, py - t * dy)

    cell = lambda y, x: (math.floor(y / coverage.GRID), math.floor(x / coverage.GRID))
    want = sorted((w, round(d, 6)) for w, e in enumerate(ends) for p in points if cell(*p) in {cell(*e[:2]), cell(*e[2:]), cell((e[0] + e[2]) / 2, (e[1] + e[3]) / 2)} and (d := dist(p, e)) <= 20)
    s = spark.createDataFrame([(w, 0, *e) for w, e in enumerate(ends)], "way_id bigint, pos bigint, lat1 double, lon1 double, lat2 double, lon2 double")
    p = spark.createDataFrame(points, "lat double, lon double")
    got = coverage.candidates(p, s, most=4)
    assert sorted((r.way_id, round(r.dist, 6)) for r in got.collect()) == want
    held = coverage.match_cells(s, most=4).groupBy("level", "ci", "cj").count().where("count > 4")
    assert held.where(f"level < {coverage.DEPTH}").isEmpty()
    assert coverage.candidates(p, s.limit(0)).count() == coverage.candidates(p.limit(0), s).count() == 0
