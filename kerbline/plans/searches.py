"""Queries that search street networks; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import areas, graph, network, search, snapping
from kerbline.plans.catalog import REACH, edges, per_box, query, required, ridden, segments
from kerbline.plans.snapping import STEPS, drawn, edge_twin, DRAWN
from kerbline.sources.domain import Domain

#: Weight of a ridden street in the pairing of odd nodes, and metres that distances_between looks.
RIDDEN, RADIUS = 4.0, 1000.0
#: A pocket is left out when the way there and back costs so many times what it holds.
SKIP = 3
#: Hops that the twins search, more than any shortest way in an area has.
_HOPS = 48


def streets(d: Domain, rows: DataFrame, times: float = 1.0) -> DataFrame:
    """(area_id, u, v, w): streets of the boxes by their weight, ridden ones at `times` as much."""
    if times != 1.0:
        rows = rows.join(ridden(d).select("way_id", "pos", F.lit(times).alias("times")), ["way_id", "pos"], "left")
    w = F.round("weight") * (F.coalesce("times", F.lit(1.0)) if times != 1.0 else F.lit(1.0))
    return graph.saved(areas.select_in_boxes(rows.withColumn("length_m", w), d.boxes).select("area_id", "u", "v", F.col("length_m").alias("w")))


def odd_nodes(e: DataFrame) -> DataFrame:
    """(r, area_id, node_id) of nodes with an odd number of required streets; an area is a request."""
    return graph.saved(network.node_degree(e).where("degree % 2 = 1").select(F.col("area_id").alias("r"), "area_id", "node_id"))


# Pairs of odd nodes.

_ODD = "odd AS MATERIALIZED (SELECT area_id, node_id FROM (SELECT area_id, unnest([u, v]) AS node_id FROM e) GROUP BY ALL HAVING count(*) % 2 = 1)"
_DISTANCES = f"""WITH e AS MATERIALIZED (SELECT * FROM required), {_ODD}, b AS MATERIALIZED (SELECT area_id, u, v, w4 AS w FROM streets UNION ALL SELECT area_id, v, u, w4 FROM streets),
reach AS (SELECT area_id, node_id AS source, node_id, 0e0 AS dist, 0 AS hops FROM odd UNION ALL SELECT area_id, source, v, min(dist + w), any_value(hops) + 1 FROM reach JOIN b USING (area_id) WHERE reach.node_id = b.u AND hops < {_HOPS} GROUP BY area_id, source, v),
dist AS MATERIALIZED (SELECT area_id, source AS u, node_id AS v, min(dist) AS dist FROM reach SEMI JOIN odd USING (area_id, node_id) WHERE source <> node_id GROUP BY ALL)"""
_PAIRED = """, p AS (SELECT area_id, u, v, dist, false AS chosen FROM dist UNION ALL
SELECT area_id, u, v, dist, twice = 2 FROM (SELECT *, count(*) FILTER (best = 1) OVER (PARTITION BY area_id, least(u, v), greatest(u, v)) AS twice FROM (SELECT *, row_number() OVER (PARTITION BY area_id, u ORDER BY dist, least(u, v), greatest(u, v)) AS best FROM (
SELECT * FROM (SELECT *, max(mine::INT) OVER (PARTITION BY area_id, least(u, v), greatest(u, v)) AS gone FROM (SELECT *, bool_or(chosen) OVER (PARTITION BY area_id, u) AS mine FROM p)) WHERE gone = 0)))),
pairs_ AS (SELECT DISTINCT area_id, u, v, dist FROM p WHERE chosen AND u < v)"""


@query("distances_between", f"{_DISTANCES} SELECT * FROM dist WHERE dist <= {RADIUS}", True)
@per_box
def distances_between(d):
    """Distances of odd nodes over all streets of the area, as far as RADIUS."""
    odd = odd_nodes(edges(d))
    dist = graph.shortest_paths(streets(d, segments(d), RIDDEN), odd, RADIUS).join(odd.select("area_id", "node_id"), ["area_id", "node_id"], "left_semi")
    return dist.where("node_id <> source").select("area_id", F.col("source").alias("u"), F.col("node_id").alias("v"), "dist")


@query("odd_node_pairing", f"{_DISTANCES}{_PAIRED} SELECT * FROM pairs_", True)
@per_box
def odd_node_pairing(d):
    return search.pairing(streets(d, segments(d), RIDDEN), odd_nodes(edges(d)))[0].select("area_id", "u", "v", "dist")


@query("sweep_length_bounds", f"""{_DISTANCES}{_PAIRED}, t AS (SELECT area_id, sum(round(length_m)) AS required_m FROM e GROUP BY 1), n AS (SELECT area_id, count(*) AS n_odd FROM odd GROUP BY 1),
h AS (SELECT area_id, sum(m) / 2 AS half FROM (SELECT area_id, u, min(dist) AS m FROM dist GROUP BY ALL) GROUP BY 1), g AS (SELECT area_id, sum(dist) AS paired FROM pairs_ GROUP BY 1)
SELECT area_id, required_m, coalesce(n_odd, 0) AS n_odd, required_m + coalesce(half, 0) AS lower_m, required_m + coalesce(paired, 0) AS greedy_m FROM t LEFT JOIN n USING (area_id) LEFT JOIN h USING (area_id) LEFT JOIN g USING (area_id)""", True)
@per_box
def sweep_length_bounds(d):
    """Required length, odd nodes, a lower bound (half of the nearest-odd distances) and a greedy estimate; ways added count by their weight."""
    e = edges(d)
    odd = odd_nodes(e)
    pairs, near = search.pairing(streets(d, segments(d), RIDDEN), odd)
    total = e.groupBy("area_id").agg(F.sum("w").alias("required_m"))
    half = near.groupBy("area_id").agg((F.sum("dist") / 2).alias("half"))
    greedy = pairs.groupBy("area_id").agg(F.sum("dist").alias("paired"))
    out = total.join(odd.groupBy("area_id").agg(F.count("*").alias("n_odd")), "area_id", "left").join(half, "area_id", "left").join(greedy, "area_id", "left").na.fill(0)
    return out.select("area_id", "required_m", "n_odd", (F.col("required_m") + F.col("half")).alias("lower_m"), (F.col("required_m") + F.col("paired")).alias("greedy_m"))


# Searches with costs of each request.

_COSTS = f"""{STEPS}, cost AS MATERIALIZED (SELECT s.route_id AS area_id, least(g.u, g.v) AS u, greatest(g.u, g.v) AS v, max(CASE WHEN r.way_id IS NULL THEN 5e0 ELSE 75e0 END) AS times
FROM hops s JOIN segments g ON s.a <> s.b AND least(s.a, s.b) = least(g.u, g.v) AND greatest(s.a, s.b) = greatest(g.u, g.v) LEFT JOIN ridden r ON r.way_id = g.way_id AND r.pos = g.pos GROUP BY ALL)"""
_TREE = f"""WITH {_COSTS}, b AS MATERIALIZED (SELECT area_id, u, v, w * coalesce(times, 1) AS w FROM streets LEFT JOIN cost USING (area_id, u, v)), bb AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT area_id, v, u, w FROM b),
s AS (SELECT area_id, unnest([min(u), max(v)]) AS node_id FROM streets GROUP BY 1),
reach AS (SELECT DISTINCT area_id, node_id, {{'d': 0e0, 'o': node_id}} AS x, 0 AS hops FROM s UNION ALL SELECT area_id, v, min({{'d': x.d + w, 'o': x.o}}), any_value(hops) + 1 FROM reach JOIN bb USING (area_id) WHERE reach.node_id = bb.u AND hops < {_HOPS} GROUP BY area_id, v),
found AS MATERIALIZED (SELECT area_id, node_id, min(x) AS x FROM reach GROUP BY ALL)"""
_PREV = "prev AS MATERIALIZED (SELECT f.area_id, f.node_id, min(g.node_id) AS prev FROM found f JOIN bb ON bb.area_id = f.area_id AND bb.v = f.node_id JOIN found g ON g.area_id = f.area_id AND g.node_id = bb.u WHERE f.x.d > 0 AND g.x.d + bb.w = f.x.d AND g.x.o = f.x.o GROUP BY ALL)"


def drawn_costs(d: Domain) -> DataFrame:
    """(r, u, v, times): what each area's drawn route adds to the streets it has passed, ridden ones more."""
    s = segments(d)
    on = snapping.traversal_penalties(drawn(d), snapping.vertices(d.nodes, s), s, ridden(d)).join(s.select("way_id", "pos", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["way_id", "pos"])
    return on.groupBy(F.col("route_id").alias("r"), "u", "v").agg(F.max("multiplier").alias("times"))


def corners(e: DataFrame) -> DataFrame:
    """(r, area_id, node_id): two sources for each area, its first and last node."""
    ends = e.groupBy("area_id").agg(F.min("u").alias("a"), F.max("v").alias("b"))
    return ends.select(F.col("area_id").alias("r"), "area_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("node_id"))


def tree(d: Domain) -> DataFrame:
    e = streets(d, segments(d))
    return search.nearest(e, search.labels(corners(e)), drawn_costs(d))


@query("shortest_path_multi_source", f"{_TREE} SELECT area_id, node_id, x.d AS dist, x.o AS origin FROM found", True)
@per_box
def shortest_path_multi_source(d):
    """Each node's nearer source, all streets of the area at their weight and those of the area's drawn route at more."""
    return tree(d).select("area_id", "node_id", "dist", "origin")


@query("path_edges", f"""{_TREE}, {_PREV}, t AS (SELECT area_id, arg_max(node_id, {{'d': x.d, 'n': node_id}}) AS node_id FROM found GROUP BY 1),
walk AS (SELECT area_id, node_id, 0 AS hop FROM t UNION ALL SELECT w.area_id, p.prev, hop + 1 FROM walk w JOIN prev p ON p.area_id = w.area_id AND p.node_id = w.node_id) SELECT area_id, node_id, hop::BIGINT AS hop FROM walk""", True)
@per_box
def path_edges(d):
    """The nodes from each area's farthest one back to its source."""
    p = graph.saved(tree(d))
    far = p.groupBy("r").agg(F.max_by("node_id", F.struct("dist", "node_id")).alias("node_id"))
    return search.traced(p, far).select(F.col("r").alias("area_id"), "node_id", "hop")


@query("closest_target", f"""{_TREE}, {_PREV}, e AS MATERIALIZED (SELECT * FROM required), {_ODD}, t AS (SELECT area_id, min({{'d': x.d, 'n': node_id, 'o': x.o}}) AS t FROM found SEMI JOIN odd USING (area_id, node_id) ANTI JOIN s USING (area_id, node_id) GROUP BY 1),
walk AS (SELECT area_id, t.n AS node_id, 0 AS hop FROM t UNION ALL SELECT w.area_id, p.prev, hop + 1 FROM walk w JOIN prev p ON p.area_id = w.area_id AND p.node_id = w.node_id)
SELECT area_id, t.n AS target, t.o AS origin, t.d AS dist, hop::BIGINT AS hop, node_id FROM walk JOIN t USING (area_id)""", True)
@per_box
def closest_target(d):
    """The odd node nearest to an area's sources, and every node of the way back from it."""
    e = streets(d, segments(d))
    end, way = search.closest(e, corners(e), odd_nodes(edges(d)), drawn_costs(d))
    return way.join(end, "r").select(F.col("r").alias("area_id"), "target", "origin", "dist", "hop", "node_id")


# Drawn routes and pockets.

_WALKS = f"""gaps AS MATERIALIZED (SELECT route_id, k, a, b FROM hops WHERE a <> b AND NOT EXISTS (SELECT 1 FROM segments g WHERE least(a, b) = least(g.u, g.v) AND greatest(a, b) = greatest(g.u, g.v))),
n AS MATERIALIZED (SELECT least(u, v) AS p, greatest(u, v) AS q, min(round(weight * 1e5)) AS w FROM segments GROUP BY ALL), links AS MATERIALIZED (SELECT p AS u, q AS v, w FROM n UNION ALL SELECT q, p, w FROM n),
reach AS (SELECT DISTINCT a, a AS node_id, 0e0 AS dist, 0 AS hops FROM gaps UNION ALL SELECT a, v, min(dist + w), any_value(hops) + 1 FROM reach JOIN links ON reach.node_id = links.u WHERE hops < 24 AND dist + w < 5e8 GROUP BY a, v),
found AS MATERIALIZED (SELECT a, node_id, min(dist) AS dist FROM reach GROUP BY ALL),
prev AS MATERIALIZED (SELECT f.a, f.node_id, min(g.node_id) AS prev FROM found f JOIN links l ON l.v = f.node_id JOIN found g ON g.a = f.a AND g.node_id = l.u WHERE f.dist > 0 AND g.dist + l.w = f.dist GROUP BY ALL),
walk AS (SELECT route_id, k, a, b AS node_id FROM gaps UNION ALL SELECT w.route_id, w.k, w.a, p.prev FROM walk w JOIN prev p ON p.a = w.a AND p.node_id = w.node_id),
path AS (SELECT w.route_id, w.k, w.node_id AS x, p.prev AS y FROM walk w JOIN prev p ON p.a = w.a AND p.node_id = w.node_id)"""


@query("required_from_route", f"""WITH {STEPS}, edge AS ({edge_twin(DRAWN, 'route_id, k')}), {_WALKS}
SELECT route_id, k, g.way_id, g.pos, how FROM (SELECT s.route_id, s.k, g.way_id, g.pos, how, row_number() OVER (PARTITION BY s.route_id, s.k, s.x, s.y ORDER BY g.way_id, g.pos) AS place
FROM (SELECT route_id, k, a AS x, b AS y, 'direct' AS how FROM hops WHERE a <> b UNION ALL SELECT *, 'path' FROM path) s JOIN segments g ON least(s.x, s.y) = least(g.u, g.v) AND greatest(s.x, s.y) = greatest(g.u, g.v)) g WHERE place = 1
UNION ALL SELECT s.route_id, s.k, x.way_id, x.pos, 'same' FROM hops s JOIN edge x ON s.route_id = x.route_id AND s.k = x.k JOIN edge y ON s.route_id = y.route_id AND s.k + 1 = y.k AND x.way_id = y.way_id AND x.pos = y.pos WHERE s.a = s.b""", True)
def required_from_route(d):
    s = segments(d)
    return snapping.required_from_route(drawn(d), snapping.vertices(d.nodes, s), s)


_POCKETS = f"""{REACH}, main AS MATERIALIZED (SELECT area_id, label FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY n DESC, label) AS place FROM (SELECT area_id, label, count(*) AS n FROM comp GROUP BY ALL)) WHERE place = 1),
heart AS MATERIALIZED (SELECT area_id, node_id FROM comp SEMI JOIN main USING (area_id, label)), t AS MATERIALIZED (SELECT * FROM streets), bb AS MATERIALIZED (SELECT area_id, u, v, w, fresh FROM t UNION ALL SELECT area_id, v, u, w, fresh FROM t),
far AS (SELECT area_id, node_id, 0e0 AS dist, 0 AS hops FROM heart UNION ALL SELECT area_id, v, min(dist + w), any_value(hops) + 1 FROM far JOIN bb USING (area_id) WHERE far.node_id = bb.u AND hops < {_HOPS} GROUP BY area_id, v),
link AS (SELECT area_id, node_id FROM heart UNION SELECT area_id, v FROM link JOIN bb USING (area_id) WHERE link.node_id = bb.u AND fresh IS NOT NULL),
held AS (SELECT area_id, label, sum(round(length_m)) AS pocket_m FROM e JOIN comp USING (area_id) WHERE comp.node_id = e.u GROUP BY ALL)"""


@query("pocket_report", f"""{_POCKETS} SELECT area_id, label, any_value(pocket_m) AS pocket_m, 2 * min(dist) AS detour_m, bool_or(l.node_id IS NOT NULL) AS fresh_link,
NOT bool_or(l.node_id IS NOT NULL) AND coalesce(2 * min(dist) > {SKIP} * any_value(pocket_m), true) AS skip
FROM comp c ANTI JOIN main USING (area_id, label) JOIN held USING (area_id, label) LEFT JOIN (SELECT area_id, node_id, min(dist) AS dist FROM far GROUP BY ALL) f USING (area_id, node_id) LEFT JOIN link l USING (area_id, node_id) GROUP BY area_id, label""", True)
@per_box
def pocket_report(d):
    """Each component beside its area's largest: length, cost to that one over all streets and back, whether fresh ones alone lead there,
    and whether a way there and back of more than three times the pocket's length makes it one to skip. Streets count by their weight."""
    e = edges(d)
    comp = graph.saved(graph.connected_components(e).select("area_id", "node_id", "label"))
    size = comp.groupBy("area_id", "label").agg(F.count("*").alias("n"))
    main = size.groupBy("area_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    held = e.join(comp.withColumnRenamed("node_id", "u"), ["area_id", "u"]).groupBy("area_id", "label").agg(F.sum("w").alias("pocket_m"))
    heart = search.labels(graph.saved(comp.join(main, ["area_id", "label"]).select(F.col("area_id").alias("r"), "area_id", "node_id")))
    every = segments(d)
    fresh = every.where(~F.col("is_avoided") & ~F.col("highway").isin("cycleway", "track")).join(ridden(d), ["way_id", "pos"], "left_anti")
    far = search.nearest(streets(d, every), heart).select("area_id", "node_id", "dist")
    linked = search.nearest(streets(d, fresh), heart).select("area_id", "node_id", F.lit(True).alias("fresh"))
    rows = comp.join(main, ["area_id", "label"], "left_anti").join(far, ["area_id", "node_id"], "left").join(linked, ["area_id", "node_id"], "left")
    best = rows.groupBy("area_id", "label").agg((2 * F.min("dist")).alias("detour_m"), F.coalesce(F.max("fresh"), F.lit(False)).alias("fresh_link"))
    skip = ~F.col("fresh_link") & F.coalesce(F.col("detour_m") > SKIP * F.col("pocket_m"), F.lit(True))
    return best.join(held, ["area_id", "label"]).select("area_id", "label", "pocket_m", "detour_m", "fresh_link", skip.alias("skip"))
