"""Distances and pairs of odd nodes against a search in plain Python over all streets of the areas."""

import heapq
from collections import Counter

import pytest

from kerbline.plans import catalog, searches  # noqa: F401
from kerbline.sources.domain import Domain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    """(distances, pairs, bounds) of every area, by heaps and sorting."""
    d = Domain(spark, DATA)
    streets, took, boxes = catalog.segments(d).collect(), {tuple(r) for r in catalog.ridden(d).select("way_id", "pos").collect()}, d.boxes.collect()
    distances, pairs, bounds = {}, set(), {}
    for b in boxes:
        inside = lambda y, x: b.south - 1e-4 <= y <= b.north + 1e-4 and b.west - 1e-4 <= x <= b.east + 1e-4
        every, need = {}, {}
        for s in streets:
            if inside(s.lat1, s.lon1) or inside(s.lat2, s.lon2):
                key, w = (min(s.u, s.v), max(s.u, s.v)), float(round(s.weight)) * (4 if (s.way_id, s.pos) in took else 1)
                every[key] = min(w, every.get(key, w))
                if (s.way_id, s.pos) not in took and not s.is_avoided:
                    need[key] = min(float(round(s.length_m)), need.get(key, float("inf")))
        odd = {n for n, c in Counter(n for key in need for n in key).items() if c % 2}
        near = {}
        for (u, v), w in every.items():
            near.setdefault(u, []).append((v, w))
            near.setdefault(v, []).append((u, w))
        for source in odd:
            best, heap = {}, [(0.0, source)]
            while heap:
                m, n = heapq.heappop(heap)
                if n not in best:
                    best[n] = m
                    for v, w in near.get(n, ()):
                        heapq.heappush(heap, (m + w, v))
            distances |= {(b.area_id, source, n): m for n, m in best.items() if n in odd and n != source}
        own = sorted((m, u, v) for (a, u, v), m in distances.items() if a == b.area_id and u < v)
        left, paired = set(odd), 0.0
        for m, u, v in own:
            if {u, v} <= left:
                left -= {u, v}
                paired += m
                pairs.add((b.area_id, u, v, m))
        half = sum(min((m for m, *uv in own if n in uv), default=0.0) for n in odd) / 2
        if need:
            bounds[b.area_id] = (sum(need.values()), len(odd), sum(need.values()) + half, sum(need.values()) + paired)
    return distances, pairs, bounds


def test_distances(spark, plain):
    near = {k: m for k, m in plain[0].items() if m <= searches.RADIUS}
    assert {(r.area_id, r.u, r.v): r.dist for r in catalog.queries()["distances_between"](spark, DATA).collect()} == near and len(near) < len(plain[0])
    assert max(plain[0].values()) > 400


def test_pairs(spark, plain):
    assert {(r.area_id, r.u, r.v, r.dist) for r in catalog.queries()["odd_node_pairing"](spark, DATA).collect()} == plain[1]


def test_bounds(spark, plain):
    assert {r.area_id: (r.required_m, r.n_odd, r.lower_m, r.greedy_m) for r in catalog.queries()["sweep_length_bounds"](spark, DATA).collect()} == plain[2]
