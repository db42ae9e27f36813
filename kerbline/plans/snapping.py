"""Queries of snapping and dumps; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import graph, network, routes, snapping
from kerbline.plans.catalog import legs, per_box, query, r6, required, ridden, rides, segments
from kerbline.plans.twins import hav
from kerbline.sources.domain import Domain

_Q = "SELECT area_id, south + 0.0013e0 AS qlat, west + 0.0021e0 AS qlon FROM boxes"
DRAWN = "SELECT area_id AS route_id, k, south + CASE WHEN k < 5 THEN k * 0.001e0 ELSE 0.005e0 END + 0.0002e0 AS qlat, west + CASE WHEN k < 5 THEN 0e0 ELSE (k - 5) * 0.0004e0 END + 0.0002e0 AS qlon FROM boxes, range(0, 11) r(k)"
STEPS = f"""drawn AS ({DRAWN}), snapped AS (SELECT route_id, k, node_id FROM (SELECT route_id, k, node_id, row_number() OVER (PARTITION BY route_id, k ORDER BY round({hav('qlat', 'qlon', 'lat', 'lon')}, 3), node_id) AS place FROM drawn CROSS JOIN vertices) WHERE place = 1),
hops AS (SELECT x.route_id, x.k, x.node_id AS a, y.node_id AS b FROM snapped x JOIN snapped y ON x.route_id = y.route_id AND x.k + 1 = y.k)"""


def edge_twin(points: str, keys: str) -> str:
    """Nearest segment to each point by brute force."""
    t = "greatest(0e0, least(1e0, coalesce((((qlon - lon1) * cos(radians(lat1))) * ((lon2 - lon1) * cos(radians(lat1))) + (qlat - lat1) * (lat2 - lat1)) / nullif(((lon2 - lon1) * cos(radians(lat1))) * ((lon2 - lon1) * cos(radians(lat1))) + (lat2 - lat1) * (lat2 - lat1), 0e0), 0e0)))"
    m = hav("qlat", "qlon", "y", "x")
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY m, way_id, pos) AS place FROM (SELECT *, round({m}, 3) AS m FROM (
SELECT *, lat1 + (lat2 - lat1) * t AS y, lon1 + (lon2 - lon1) * t AS x FROM (SELECT q.*, way_id, pos, u, v, lat1, lon1, lat2, lon2, {t} AS t FROM ({points}) q CROSS JOIN segments s WHERE NOT s.is_avoided)))) WHERE place = 1"""


def centers(d: Domain) -> DataFrame:
    """A point inside each box that lies on no street."""
    return d.boxes.select("area_id", (F.col("south") + 0.0013).alias("qlat"), (F.col("west") + 0.0021).alias("qlon"))


def drawn(d: Domain) -> DataFrame:
    """A drawn route for each box: up its western side, then slowly along its northern one."""
    k = F.col("k")
    up, along = F.when(k < 5, k * 0.001).otherwise(0.005), F.when(k < 5, 0.0).otherwise((k - 5) * 0.0004)
    rows = d.boxes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))))
    return rows.select(F.col("area_id").alias("route_id"), "k", (F.col("south") + up + 0.0002).alias("qlat"), (F.col("west") + along + 0.0002).alias("qlon"))


_FLAT = "(lon2 - lon0) * (cos(radians(lat)) * 111320e0) AS dx, (lat2 - lat0) * 111320e0 AS dy, (lon - lon0) * (cos(radians(lat)) * 111320e0) AS px, (lat - lat0) * 111320e0 AS py"


@query("project_planar", f"SELECT activity_id, seq, round(sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)), 6) AS dist, round(t, 6) AS t, round(sqrt(dx * dx + dy * dy), 6) AS len_m FROM (SELECT *, greatest(0e0, least(1e0, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0e0), 0e0))) AS t FROM (SELECT activity_id, seq, {_FLAT} FROM legs WHERE lat0 IS NOT NULL AND lat2 IS NOT NULL))")
def project_planar(d):
    """Each point against the straight line between its neighbours, on a plane tangent at the point."""
    dist, t, len_m = geo.project_planar(*(F.col(c) for c in ("lat", "lon", "lat0", "lon0", "lat2", "lon2")))
    return legs(d).where("lat0 is not null and lat2 is not null").select("activity_id", "seq", r6(dist, "dist"), r6(t, "t"), r6(len_m, "len_m"))


@query("nearest_edge_join", f"SELECT area_id, way_id, pos, u, v, round(y, 6) AS lat, round(x, 6) AS lon, m FROM ({edge_twin(_Q, 'area_id')})")
def nearest_edge_join(d):
    e = snapping.nearest_edge(centers(d), ["area_id"], segments(d))
    return e.select("area_id", "way_id", "pos", "u", "v", r6("lat", "lat"), r6("lon", "lon"), "m")


@query("nodes_within_cells", f"""WITH q AS ({_Q}), c AS (SELECT DISTINCT unnest([u, v]) AS node_id, floor((lat1 + (lat2 - lat1) * k / st) / 0.0005e0)::BIGINT AS ci, floor((lon1 + (lon2 - lon1) * k / st) / 0.0005e0)::BIGINT AS cj
FROM (SELECT *, unnest(range(0, st::BIGINT + 1)) AS k FROM (SELECT *, greatest(1, ceil(greatest(abs(lat2 - lat1), abs(lon2 - lon1)) / 0.00025e0)) AS st FROM segments)))
SELECT DISTINCT area_id, node_id FROM q JOIN c ON ci BETWEEN floor(qlat / 0.0005e0) - 2 AND floor(qlat / 0.0005e0) + 2 AND cj BETWEEN floor(qlon / 0.0005e0) - 2 AND floor(qlon / 0.0005e0) + 2""")
def nodes_within_cells(d):
    return snapping.nodes_within(centers(d), ["area_id"], segments(d), 0.0005, 2)


@query("traversal_penalty_join", f"""WITH {STEPS} SELECT DISTINCT s.route_id, g.way_id, g.pos, CASE WHEN r.way_id IS NULL THEN 5e0 ELSE 75e0 END AS multiplier
FROM hops s JOIN segments g ON s.a <> s.b AND least(s.a, s.b) = least(g.u, g.v) AND greatest(s.a, s.b) = greatest(g.u, g.v) LEFT JOIN ridden r ON r.way_id = g.way_id AND r.pos = g.pos""")
@lambda f: per_box(f, "route_id")
def traversal_penalty_join(d):
    s = segments(d)
    return snapping.traversal_penalties(drawn(d), snapping.vertices(d.nodes, s), s, ridden(d))


@query("trim_overlap", """WITH a AS (SELECT activity_id, max(seq) OVER (PARTITION BY activity_id) - seq AS k, lat, lon FROM rides),
b AS (SELECT activity_id, k, lat + CASE WHEN k > activity_id % 9 THEN 0.001e0 ELSE 0e0 END AS y, lon AS x FROM a)
SELECT activity_id AS route_id, coalesce(min(CASE WHEN k > 0 AND (round(lat, 6) <> round(y, 6) OR round(lon, 6) <> round(x, 6)) THEN k END) - 1, max(k))::BIGINT AS n FROM a JOIN b USING (activity_id, k) GROUP BY 1""")
def trim_overlap(d):
    """Each ride against a way back that follows it for a few vertices and then leaves it."""
    one = rides(d).select(F.col("activity_id").alias("route_id"), "seq", "lat", "lon")
    last = one.groupBy("route_id").agg(F.max("seq").alias("hi"))
    back = one.join(last, "route_id").withColumn("k", F.col("hi") - F.col("seq"))
    leaves = F.when(F.col("k") > F.col("route_id") % 9, 0.001).otherwise(0.0)
    return snapping.shared_run(one, back.select("route_id", F.col("k").alias("seq"), (F.col("lat") + leaves).alias("lat"), "lon"))


@query("natural_endpoint", f"""WITH q AS ({_Q}), g AS (SELECT area_id, node_id, count(*) AS degree FROM (SELECT area_id, unnest([u, v]) AS node_id FROM required) GROUP BY ALL),
c AS (SELECT area_id, node_id, degree, round({hav('qlat', 'qlon', 'lat', 'lon')}, 3) AS m FROM g JOIN nodes USING (node_id) JOIN q USING (area_id))
SELECT area_id, node_id, odd FROM (SELECT *, degree % 2 = 1 AND m <= 400 AS odd, row_number() OVER (PARTITION BY area_id ORDER BY degree % 2 = 1 AND m <= 400 DESC, m, node_id) AS place FROM c) WHERE place = 1""")
def natural_endpoint(d):
    return snapping.natural_endpoint(centers(d), network.node_degree(required(d)), d.nodes)


@query("scan_activities", "SELECT activity_id, sport_type, distance_m FROM activities WHERE activity_id % 10 > 1")
def scan_activities(d):
    """Write pages of activities as JSON documents, read them back with a fixed schema and keep those with a trace."""
    a = F.col("activity_id")
    line = F.when(a % 10 == 0, None).when(a % 10 == 1, "").otherwise(F.col("polyline"))
    rows = d.activities.join(routes.encode_polyline(d.points), "activity_id")
    one = F.struct(a.alias("id"), "sport_type", F.col("distance_m").alias("distance"), F.struct(line.alias("summary_polyline")).alias("map"))
    path = graph.folder(d.spark, "pages")
    rows.select(F.floor(a / 200).alias("page"), one.alias("x")).groupBy("page").agg(F.to_json(F.struct(F.collect_list("x").alias("items"))).alias("value")).select("value").write.text(path)
    items = "items array<struct<id:bigint,sport_type:string,distance:double,map:struct<summary_polyline:string>>>"
    back = d.spark.read.schema(items).json(path).select(F.explode("items").alias("x")).select("x.*")
    return back.where("map.summary_polyline <> ''").select(F.col("id").alias("activity_id"), "sport_type", F.col("distance").alias("distance_m"))


@query("load_city_polygons", """SELECT polygon_id, i - 1 AS seq, y1 AS lat, x1 AS lon FROM corners WHERE polygon_id % 3 < 2
UNION ALL SELECT polygon_id, unnest([0, 1, 2, 3]), unnest([s, s, n, n]), unnest([w, e, e, w]) FROM (SELECT polygon_id, min(y1) AS s, max(y1) AS n, min(x1) AS w, max(x1) AS e FROM corners WHERE polygon_id % 3 = 2 GROUP BY 1)""")
def load_city_polygons(d):
    """Place results as GeoJSON: a polygon's outer ring, the ring with most corners of many, else the bounding box; axes are swapped."""
    flip = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    kind = F.when(F.col("polygon_id") % 3 == 0, "Polygon").when(F.col("polygon_id") % 3 == 1, "MultiPolygon").otherwise("Point")
    of = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    shape = F.when(kind == "Polygon", F.to_json(F.array(flip))).when(kind == "MultiPolygon", F.to_json(F.array(F.array(F.slice(flip, 1, 3)), F.array(flip)))).otherwise("[0.0,0.0]")
    box = F.array(of(F.array_min, "lat"), of(F.array_max, "lat"), of(F.array_min, "lon"), of(F.array_max, "lon"))
    docs = graph.saved(d.rings.select("polygon_id", F.concat(F.lit('{"boundingbox":'), F.to_json(box), F.lit(',"geojson":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}")).alias("json")))
    type_, at = F.get_json_object("json", "$.geojson.type"), F.get_json_object("json", "$.geojson.coordinates")
    outer = F.transform(F.from_json(at, "array<array<array<array<double>>>>"), lambda p: F.get(p, F.lit(0)))
    most = F.reduce(outer, F.array().cast("array<array<double>>"), lambda a, r: F.when(F.size(r) > F.size(a), r).otherwise(a))
    s, n, w, e = (F.get(F.from_json(F.get_json_object("json", "$.boundingbox"), "array<double>"), F.lit(i)) for i in range(4))
    frame = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n))
    ring = F.when(type_ == "Polygon", F.get(F.from_json(at, "array<array<array<double>>>"), F.lit(0))).when(type_ == "MultiPolygon", most).otherwise(frame)
    return docs.select("polygon_id", F.posexplode(ring).alias("seq", "p")).select("polygon_id", F.col("seq").cast("bigint").alias("seq"), F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon"))
