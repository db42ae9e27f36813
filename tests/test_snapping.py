"""Snapping on small inputs, and pockets against a search in plain Python."""

import heapq
import math
from collections import defaultdict

from pyspark.sql import functions as F

from kerbline.operators import areas, snapping
from kerbline.plans import catalog, searches  # noqa: F401
from kerbline.sources.domain import Domain

DATA = "/root/testdata/sf0.001"


def test_nearest_far_away_and_empty(spark):
    nodes = spark.createDataFrame([(2, 0.0, 0.0), (1, 0.0, 0.0), (3, 10.0, 10.0)], "node_id bigint, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0001, 0.0), (2, 40.0, -120.0), (3, 9.0, 9.5)], "p bigint, qlat double, qlon double")
    got = {r["p"]: r["node_id"] for r in snapping.nearest_node(points, ["p"], nodes).collect()}
    rad = math.radians
    cos = lambda a, b, c, e: math.sin(rad(a)) * math.sin(rad(c)) + math.cos(rad(a)) * math.cos(rad(c)) * math.cos(rad(b - e))
    assert got == {p: min((round(math.acos(cos(y, x, b, c)), 9), n) for n, b, c in nodes.collect())[1] for p, y, x in points.collect()}
    assert snapping.nearest_node(points, ["p"], nodes.limit(0)).count() == 0
    assert snapping.nearest_node(points.limit(0), ["p"], nodes).count() == 0


def test_shared_run(spark):
    schema = "route_id bigint, seq bigint, lat double, lon double"
    a = [(1, k, float(k), 0.0) for k in range(6)] + [(2, k, float(k), 0.0) for k in range(3)] + [(3, k, float(k), 0.0) for k in range(4)]
    b = [(1, k, 5.0 - k if k < 3 else 50.0 + k, 0.0) for k in range(6)] + [(2, k, 2.0 - k, 0.0) for k in range(3)] + [(3, 0, 3.0, 0.0), (3, 1, 9.0, 0.0)]
    got = {r["route_id"]: r["n"] for r in snapping.shared_run(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {1: 2, 2: 2, 3: 0}


def reach(links, starts):
    best, heap = {}, [(0.0, s) for s in starts]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in links[x]:
                heapq.heappush(heap, (d + w, y))
    return best


def test_pockets(spark):
    d = Domain(spark, DATA)
    every = catalog.segments(d).cache()
    used = catalog.ridden(d).cache()
    fresh = every.where(~F.col("is_avoided") & ~F.col("highway").isin("cycleway", "track")).join(used, ["way_id", "pos"], "left_anti")

    def links(rows):
        out = defaultdict(lambda: defaultdict(list))
        for r in rows.select("area_id", "u", "v", F.round("length_m").alias("w")).collect():
            out[r["area_id"]][r["u"]].append((r["v"], r["w"]))
            out[r["area_id"]][r["v"]].append((r["u"], r["w"]))
        return out

    dear = lambda rows: areas.select_in_boxes(rows.withColumn("length_m", F.col("weight")), d.boxes)
    need, wide, new = (links(x) for x in (catalog.required(d), dear(every), dear(fresh)))
    want = set()
    for area, own in need.items():
        parts, left = [], set(own)
        while left:
            part = set(reach(own, [min(left)]))
            parts.append(part)
            left -= part
        main = max(parts, key=lambda p: (len(p), -min(p)))
        far, linked = reach(wide[area], main), reach(new[area], main)
        for p in parts:
            if p is not main:
                m = sum(w for x in p for _, w in own[x]) / 2
                trip = 2 * min((far[x] for x in p if x in far), default=float("inf"))
                joined = any(x in linked for x in p)
                want.add((area, min(p), m, None if trip == float("inf") else trip, joined, not joined and trip > 3 * m))
    assert {tuple(r) for r in catalog.queries()["pocket_report"](spark, DATA).collect()} == want
