"""Searches against heaps in plain Python, on small networks."""

import heapq
import random
from collections import defaultdict

import pytest

from kerbline.functions import geo
from kerbline.operators import search, snapping

EDGES, NODES = "area_id bigint, u bigint, v bigint, w double", "r bigint, area_id bigint, node_id bigint"


def links(edges, times=None):
    out = defaultdict(lambda: defaultdict(dict))
    for a, u, v, w in edges:
        w *= (times or {}).get((min(u, v), max(u, v)), 1)
        for x, y in ((u, v), (v, u)):
            out[a][x][y] = min(w, out[a][x].get(y, w))
    return out


def reach(net, starts):
    """node: (dist, origin), ties to the smallest origin."""
    best, heap = {}, [(0.0, s, s) for s in starts]
    while heap:
        d, o, x = heapq.heappop(heap)
        if x not in best:
            best[x] = (d, o)
            for y, w in net.get(x, {}).items():
                heapq.heappush(heap, (d + w, o, y))
    return best


def network(seed, areas=3, size=18):
    """Random sparse networks with dear edges, some of them in two parts, and ties."""
    rng, out = random.Random(seed), []
    for a in range(areas):
        part = [n for n in range(size)]
        for n in part[1:]:
            if n != size // 2 or a != 1:
                out.append((a, n, rng.randrange(n // (size // 2) * (size // 2) if a == 1 else 0, n), float(rng.choice([1, 2, 3, 50]))))
        out += [(a, x, y, float(rng.choice([1, 2, 40]))) for x, y in (rng.sample(part[: size // 2], 2) for _ in range(6))]
    return out


@pytest.mark.parametrize("delta, hops", [(1e9, 3), (4.0, 2)])
def test_nearest_with_costs_of_each_request(spark, delta, hops):
    """Buckets or none: the same distances, origins and smallest predecessors; several requests look at one area with their own costs."""
    edges = network(1)
    requests = {7: (0, [3, 11]), 8: (0, [3]), 9: (1, [1]), 10: (2, [0, 5, 9])}
    costs = [(7, min(u, v), max(u, v), 15.0) for a, u, v, _ in edges[::3] if a == 0]
    costs = sorted(set(costs))
    start = search.labels(spark.createDataFrame([(r, a, n) for r, (a, ns) in requests.items() for n in ns], NODES))
    rounds = []
    got = search.nearest(spark.createDataFrame(edges, EDGES), start, spark.createDataFrame(costs, "r bigint, u bigint, v bigint, times double"), delta=delta, hops=hops, rounds=rounds).collect()
    want = set()
    for r, (a, ns) in requests.items():
        net = links(edges, {(u, v): t for q, u, v, t in costs if q == r})[a]
        best = reach(net, ns)
        for x, (d, o) in best.items():
            prev = min((y for y, w in net[x].items() if d > 0 and best[y] == (d - w, o)), default=None)
            want.add((r, a, x, o, d, prev))
    assert {(g.r, g.area_id, g.node_id, g.origin, g.dist, g.prev) for g in got} == want and len(got) == len(want)


def test_two_nearest_and_limit(spark):
    edges = network(2, areas=1)
    odd = [2, 5, 7, 12]
    net = links(edges)[0]
    far = {o: reach(net, [o]) for o in odd}
    start = search.labels(spark.createDataFrame([(0, 0, n) for n in odd], NODES))
    got = search.nearest(spark.createDataFrame(edges, EDGES), start, k=2, hops=2, most=60.0).collect()
    want = {(x, *p) for x in net for p in sorted((f[x][0], o) for o, f in far.items() if x in f and f[x][0] <= 60)[:2]}
    assert {(g.node_id, g.dist, g.origin) for g in got} == want


def test_pairing(spark):
    """Pairs are those of the whole sorted list of pairs; a node without any other stays alone."""
    edges = network(3) + [(5, 1, 2, 1.0)]
    rng = random.Random(4)
    odd = {a: sorted(rng.sample(range(18), 9)) for a in range(3)} | {5: [1]}
    pairs, near = search.pairing(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(a, a, n) for a, ns in odd.items() for n in ns], NODES))
    want, first = set(), set()
    for a, ns in odd.items():
        far = {n: reach(links(edges)[a], [n]) for n in ns}
        left = set(ns)
        for d, u, v in sorted((far[u][v][0], u, v) for u in ns for v in ns if u < v and v in far[u]):
            if {u, v} <= left:
                left -= {u, v}
                want.add((a, u, v, d))
        first |= {(a, n, *min((far[n][m][0], m) for m in ns if m != n and m in far[n])) for n in ns if any(m != n and m in far[n] for m in ns)}
    assert {(p.area_id, p.u, p.v, p.dist) for p in pairs.collect()} == want
    assert {(p.area_id, p.node_id, p.dist, p.other) for p in near.collect()} == first


def test_between_and_closest(spark):
    """Ways of many pairs at once cost what a heap finds, step over edges only, and none is found where there is none."""
    edges = network(5)
    df = spark.createDataFrame(edges, EDGES)
    pairs = [(k, k % 3, (k * 5) % 18, (k * 7 + 3) % 18) for k in range(24)] + [(30, 2, 4, 4), (31, 1, 0, 17)]
    way = defaultdict(list)
    for g in search.between(df, spark.createDataFrame(pairs, "r bigint, area_id bigint, s bigint, t bigint"), delta=30.0, hops=2).collect():
        way[g.r].append((g.k, g.node_id, g.dist))
    for r, a, s, t in pairs:
        net = links(edges)[a]
        best = reach(net, [s])
        steps = [n for _, n, _ in sorted(way[r])]
        if t not in best:
            assert not steps
            continue
        assert (steps[0], steps[-1]) == (s, t) and [k for k, *_ in sorted(way[r])] == list(range(len(steps)))
        assert sum(net[x][y] for x, y in zip(steps, steps[1:])) == best[t][0] == way[r][0][2]
    end, back = search.closest(df, spark.createDataFrame([(a, a, 0) for a in range(3)], NODES), spark.createDataFrame([(a, n) for a in range(3) for n in (0, 8, 16)], "r bigint, node_id bigint"), hops=2)
    for e in end.collect():
        best = reach(links(edges)[e.r], [0])
        assert (e.dist, e.target) == min((best[n][0], n) for n in (8, 16) if n in best) and e.origin == 0
        steps = [b.node_id for b in sorted(back.where(f"r = {e.r}").collect(), key=lambda b: b.hop)]
        assert (steps[0], steps[-1]) == (e.target, 0) and sum(links(edges)[e.r][x][y] for x, y in zip(steps, steps[1:])) == e.dist


def test_long_way_in_few_rounds(spark):
    """1 000 hops are traced in at most 12 rounds; a way of 40 hops takes fewer rounds than hops."""
    rounds = []
    tree = spark.createDataFrame([(1, n, n - 1 if n else None) for n in range(1001)], "r bigint, node_id bigint, prev bigint")
    got = search.traced(tree, spark.createDataFrame([(1, 1000)], "r bigint, node_id bigint"), rounds)
    assert sorted((g.hop, g.node_id) for g in got.collect()) == [(k, 1000 - k) for k in range(1001)] and len(rounds) <= 12
    rounds = []
    chain = spark.createDataFrame([(0, n, n + 1, 100.0) for n in range(40)], EDGES)
    found = search.nearest(chain, search.labels(spark.createDataFrame([(0, 0, 0)], NODES)), rounds=rounds)
    assert found.where("node_id = 40").first().dist == 4000.0 and len(rounds) < 20


def test_a_passed_block_is_avoided(spark):
    """Two columns and three rows of streets: the way turns back over the western block until having passed it makes that dearer."""
    at = {1: (47.6560, -117.4200), 2: (47.6560, -117.4100), 3: (47.6549, -117.4200), 4: (47.6549, -117.4101), 5: (47.6520, -117.4200), 6: (47.6520, -117.4100)}
    rows = [(w, k, u, v, *at[u], *at[v], False) for w, line in ((10, (1, 3, 5)), (11, (2, 4, 6)), (12, (1, 2)), (13, (3, 4)), (14, (5, 6))) for k, (u, v) in enumerate(zip(line, line[1:]))]
    s = spark.createDataFrame(rows, "way_id bigint, pos bigint, u bigint, v bigint, lat1 double, lon1 double, lat2 double, lon2 double, is_avoided boolean")
    s = s.withColumn("weight", geo.haversine_m(s.lat1, s.lon1, s.lat2, s.lon2))
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node_id bigint, lat double, lon double")
    drawn = spark.createDataFrame([(0, k, *at[n]) for k, n in enumerate((5, 3, 1))], "route_id bigint, k bigint, qlat double, qlon double")
    on = snapping.traversal_penalties(drawn, nodes, s, s.where("way_id < 0").select("way_id", "pos"), 5.0).join(s, ["way_id", "pos"])
    costs = on.selectExpr("route_id as r", "least(u, v) as u", "greatest(u, v) as v", "multiplier as times")
    one, edges = spark.createDataFrame([(0, 0, 1)], NODES), s.selectExpr("0L as area_id", "u", "v", "weight as w")
    goal = spark.createDataFrame([(0, 4)], "r bigint, node_id bigint")
    way = lambda c: [b.node_id for b in sorted(search.closest(edges, one, goal, c)[1].collect(), key=lambda b: b.hop)]
    assert (way(None), way(costs)) == ([4, 3, 1], [4, 2, 1])


def test_sparse_drawn_route(spark):
    """A step between nodes that no segment joins takes every segment of the cheapest way; a direct one may be avoided; equal points are no step."""
    at = {1: (0.0, 0.0), 2: (0.0, 0.001), 3: (0.0, 0.002), 4: (0.001, 0.0), 5: (0.001, 0.002)}
    ends = [(1, 2, False, 1.0), (2, 3, False, 1.0), (1, 4, True, 12.0), (4, 5, True, 12.0), (3, 5, False, 1.0)]
    rows = [(k, 0, u, v, *at[u], *at[v], bad, 100.0 * x) for k, (u, v, bad, x) in enumerate(ends)]
    s = spark.createDataFrame(rows, "way_id bigint, pos bigint, u bigint, v bigint, lat1 double, lon1 double, lat2 double, lon2 double, is_avoided boolean, weight double")
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node_id bigint, lat double, lon double")
    points = [at[1], at[5], at[5], at[4], (0.0, 0.0014), (0.0, 0.0011)]
    drawn = spark.createDataFrame([(9, k, *p) for k, p in enumerate(points)], "route_id bigint, k bigint, qlat double, qlon double")
    got = sorted((g.k, g.way_id, g.how) for g in snapping.required_from_route(drawn, nodes, s).collect())
    assert got == [(0, 0, "path"), (0, 1, "path"), (0, 4, "path"), (2, 3, "direct"), (3, 0, "path"), (3, 2, "path"), (4, 1, "same")]
