"""Queries of element documents, places and cities; importing this module adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import areas, coverage, graph
from kerbline.plans.catalog import moving, query, r6
from kerbline.plans.twins import CELL, hav
from kerbline.sources import elements
from kerbline.sources.domain import Domain

# Documents of the network: a node in two tiles, a way in two others; a third of the ways has coordinates of its own with gaps, a node in 41 is in
# no document, some ways share their number with a relation, and a tile in seven has a broken document besides.

PARTS = 4
_WAY = """w AS (SELECT way_id, w.*, n, g FROM (SELECT way_id, count(*) AS n, list(node_id ORDER BY pos) AS nodes,
CASE WHEN way_id % 3 = 1 THEN count(*) END AS g FROM way_nodes GROUP BY 1) JOIN ways w USING (way_id))"""
_PLACED = "(way_id % 3 = 1 AND node_id % 37 <> 5 OR node_id % 41 <> 7)"


def documents(d: Domain) -> DataFrame:
    """(value): the element documents as lines of JSON."""
    none = F.lit(None).cast("double")
    nulls = {"nodes": "array<bigint>", "geometry": "array<struct<lat:double,lon:double>>", "tags": "map<string,string>"}
    pair = lambda t: F.explode(F.array(t, t + 1)).alias("tile")
    node = d.nodes.where(F.col("node_id") % 41 != 7).select(pair(F.floor(F.col("node_id") / 50)), F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), "lat", "lon", *(F.lit(None).cast(t).alias(c) for c, t in nulls.items())).alias("e"))
    points = d.way_nodes.join(d.nodes, "node_id")
    seen = F.col("node_id") % 37 != 5
    own = F.struct(F.when(seen, F.col("lat")).alias("lat"), F.when(seen, F.col("lon")).alias("lon"))
    lines = points.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", own.alias("g")))).alias("p"))
    w = F.col("way_id")
    of = d.ways.join(lines, "way_id").withColumn("tile", F.explode(F.array(w % 5, w % 5 + 1)))
    known = [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for c, k in elements.TAGS.items()]
    tags = F.map_from_entries(F.filter(F.array(*known, F.struct(F.lit("tile").alias("key"), F.col("tile").cast("string").alias("value"))), lambda t: t["value"].isNotNull()))
    way = lambda kind: F.struct(F.lit(kind).alias("type"), w.alias("id"), none.alias("lat"), none.alias("lon"), F.transform("p", lambda x: x["node_id"]).alias("nodes"), F.when(w % 3 == 1, F.transform("p", lambda x: x["g"])).alias("geometry"), tags.alias("tags")).alias("e")
    every = node.union(of.select("tile", way("way"))).union(of.where(w % 9 == 2).select("tile", way("relation")))
    # A tile is dealt over several documents, so that none grows with the network.
    part = every.withColumn("part", F.pmod(F.xxhash64("e.type", "e.id"), F.lit(PARTS)))
    text = part.groupBy("tile", "part").agg(F.to_json(F.struct("tile", F.collect_list("e").alias("elements"))).alias("value"))
    broken = every.select("tile").distinct().where("tile % 7 = 3").select(F.concat(F.lit('{"tile":'), F.col("tile").cast("string"), F.lit(',"elements":[{"type":"node"')).alias("value"))
    return text.select("value").union(broken)


def scanned(d: Domain) -> tuple[DataFrame, DataFrame]:
    path = graph.folder(d.spark, "elements")
    documents(d).write.text(path)
    return elements.read_json(d.spark, path)


_ELEMENTS = f"""WITH {_WAY}, e AS (SELECT unnest([node_id // 50, node_id // 50 + 1]) AS tile, 'node' AS type, node_id AS id, lat, lon, NULL AS n_nodes, NULL AS n_own, NULL AS highway, NULL AS construction_highway, 0 AS n_tags FROM nodes WHERE node_id % 41 <> 7
UNION ALL SELECT way_id % 5 + k, kind, way_id, NULL, NULL, n, g, highway, construction_highway, 1 + (highway IS NOT NULL)::INT + (surface IS NOT NULL)::INT + (construction IS NOT NULL)::INT + (construction_highway IS NOT NULL)::INT + (access IS NOT NULL)::INT
FROM w, range(2) r(k), (VALUES ('way'), ('relation')) t(kind) WHERE kind = 'way' OR way_id % 9 = 2)"""


def described(e: DataFrame) -> list[Column]:
    """What the twins can tell of an element."""
    return ["type", "id", r6("lat", "lat"), r6("lon", "lon"), *(F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint").alias(n) for c, n in (("nodes", "n_nodes"), ("geometry", "n_own"))), elements.tag("highway").alias("highway"), elements.tag("construction:highway").alias("construction_highway"), F.coalesce(F.size("tags"), F.lit(0)).cast("bigint").alias("n_tags")]


@query("scan_osm_elements", f"""{_ELEMENTS} SELECT tile, type, id, round(lat, 6) AS lat, round(lon, 6) AS lon, n_nodes::BIGINT AS n_nodes, n_own::BIGINT AS n_own, highway, construction_highway, n_tags::BIGINT AS n_tags FROM e
UNION ALL SELECT DISTINCT tile, 'broken', NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL, NULL, 0::BIGINT FROM e WHERE tile % 7 = 3""")
def scan_osm_elements(d):
    """Every element of the documents, written as files and read back with a fixed schema; broken documents are told apart."""
    good, bad = scanned(d)
    none = lambda t: F.lit(None).cast(t)
    number = F.regexp_extract("value", r'"tile":(\d+)', 1).cast("bigint")
    lost = bad.select(number.alias("tile"), F.lit("broken"), none("bigint"), none("double"), none("double"), none("bigint"), none("bigint"), none("string"), none("string"), F.lit(0).cast("bigint"))
    return good.select("tile", *described(good)).union(lost)


@query("merge_tiles", f"{_ELEMENTS} SELECT type, id, min(tile) AS tile, round(any_value(lat), 6) AS lat, round(any_value(lon), 6) AS lon, any_value(n_nodes)::BIGINT AS n_nodes, any_value(n_own)::BIGINT AS n_own, any_value(highway) AS highway, any_value(construction_highway) AS construction_highway, any_value(n_tags)::BIGINT AS n_tags FROM e GROUP BY type, id")
def merge_tiles(d):
    """Overlapping tiles as one set: of equal type and id the first tile's element, whole."""
    one = elements.merged(scanned(d)[0])
    own = F.coalesce(elements.tag("tile").cast("bigint"), "tile")  # ways say themselves which tile they came from
    return one.select(own.alias("tile"), *described(one))


def network_of(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Ways and nodes of the merged documents."""
    one = graph.saved(elements.merged(scanned(d)[0]))
    return elements.ways_of(one), elements.nodes_of(one)


@query("way_segments", f"""SELECT way_id, pos, u, v, round(lat1, 6) AS lat1, round(lon1, 6) AS lon1, round(lat2, 6) AS lat2, round(lon2, 6) AS lon2 FROM (SELECT way_id, pos, node_id AS u, lead(node_id) OVER w AS v, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, ok, lead(ok) OVER w AS ok2
FROM (SELECT *, {_PLACED} AS ok FROM way_nodes JOIN nodes USING (node_id)) WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE ok AND ok2""")
def way_segments(d):
    """Pairs of consecutive nodes with coordinates of the way itself, else of the node; pairs without go."""
    s = elements.segments_of(elements.vertices_of(*network_of(d)))
    return s.select("way_id", "pos", "u", "v", *(r6(c, c) for c in coverage.ENDS))


@query("way_polyline", """SELECT way_id, count(*) AS n, round(sum(lat), 6) AS sum_lat, round(arg_min(lon, pos), 6) AS first_lon FROM way_nodes JOIN nodes USING (node_id)
WHERE CASE WHEN way_id % 3 = 1 THEN node_id % 37 <> 5 ELSE node_id % 41 <> 7 END GROUP BY 1 HAVING count(*) >= 2""")
def way_polyline(d):
    lines = elements.polylines_of(*network_of(d))
    return lines.select("way_id", F.size("line").cast("bigint").alias("n"), r6(F.aggregate("line", F.lit(0.0), lambda a, x: a + x["lat"]), "sum_lat"), r6(F.get("line", F.lit(0))["lon"], "first_lon"))


@query("scan_osm_xml", """SELECT 'way' AS type, way_id AS id, count(*) AS n, any_value(highway) AS highway, min(node_id) AS least_node, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon FROM way_nodes JOIN ways USING (way_id) WHERE highway <> 'service' AND access IS DISTINCT FROM 'private' GROUP BY way_id HAVING count(*) >= 2
UNION ALL SELECT 'node', node_id, NULL, NULL, NULL, round(lat, 6), round(lon, 6) FROM nodes""")
def scan_osm_xml(d):
    """Write nodes and ways as an XML dump and read it back; ways that no route may take go."""
    nd = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: F.concat(F.lit('<nd ref="'), s["node_id"].cast("string"), F.lit('"/>')))
    rows = d.way_nodes.groupBy("way_id").agg(F.array_join(nd, "").alias("nd")).join(d.ways, "way_id")
    tag = lambda k: F.coalesce(F.concat(F.lit(f'<tag k="{k}" v="'), geo.xml_escape(F.col(k)), F.lit('"/>')), F.lit(""))
    ways = rows.select(F.concat(F.lit('<way id="'), F.col("way_id").cast("string"), F.lit('">'), "nd", tag("highway"), tag("access"), F.lit("</way>")).alias("value"))
    place = lambda k: F.concat(F.lit(f' {k}="'), F.col(k).cast("string"), F.lit('"'))
    end = F.when(F.col("node_id") % 3 == 0, '><tag k="name" v="a"/></node>').otherwise("/>")
    nodes = d.nodes.select(F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('"'), place("lat"), place("lon"), end).alias("value"))
    path = graph.folder(d.spark, "dump")
    nodes.union(ways).write.text(path)
    e = elements.read_xml(d.spark, path)
    highway, access = elements.tag("highway"), F.coalesce(elements.tag("access"), F.lit(""))
    open_ = highway.isin(*ROUTES) & ~access.isin("private", "no")
    return e.where((F.col("type") == "node") | open_).select("type", "id", F.when(F.col("type") == "way", F.size("nodes")).cast("bigint").alias("n"), highway.alias("highway"), F.array_min("nodes").alias("least_node"), r6("lat", "lat"), r6("lon", "lon"))


#: Classes that a dump is read for.
ROUTES = "motorway trunk primary secondary tertiary unclassified residential living_street motorway_link trunk_link primary_link secondary_link tertiary_link track cycleway".split()

# Places.

_LEVELS = ("city", "town", "village", "hamlet", "municipality")


@query("load_places", """SELECT place_key, CASE WHEN place_key % 11 <> 10 THEN city END AS city, CASE WHEN place_key % 4 <> 3 THEN county END AS county, state, CASE WHEN place_key % 13 <> 12 THEN country END AS country FROM places""")
def load_places(d):
    """Address documents as files: a place under one of five names, those before it empty or absent, districts for counties, regions for states."""
    k = F.col("place_key")
    entry = lambda key, value, when=None: F.struct(F.lit(key).alias("key"), (value if when is None else F.when(when, value)).alias("value"))
    empty, null = F.lit(""), F.lit(None).cast("string")
    city = [entry(name, F.when(k % 11 == 10, empty).when(k % 5 == n, F.col("city")).when(k % 2 == 0, empty).otherwise(F.when(k % 5 < n, F.lit("elsewhere")))) for n, name in enumerate(_LEVELS)]
    rest = [entry("county", F.when(k % 4 == 0, F.col("county")).when(k % 4 == 1, empty)), entry("district", F.col("county"), k % 4 != 3), entry("state", F.col("state"), k % 2 == 0), entry("region", F.col("state"), k % 2 == 1), entry("country", F.when(k % 13 == 12, null).otherwise(F.col("country")))]
    told = F.map_from_entries(F.filter(F.array(*city, *rest), lambda e: e["value"].isNotNull()))
    path = graph.folder(d.spark, "addresses")
    d.places.select(F.to_json(F.struct("place_key", told.alias("address"))).alias("value")).write.text(path)
    back = d.spark.read.text(path).select(F.get_json_object("value", "$.place_key").cast("bigint").alias("place_key"), F.col("value").alias("json"))
    return elements.addresses(back).drop("json")


# Cities.

_CITY = f"""WITH m AS (SELECT way_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY way_id) AS n FROM way_nodes) WHERE k = n // 2),
own AS MATERIALIZED (SELECT polygon_id, way_id FROM m JOIN inside USING (node_id)),
pieces AS (SELECT way_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, greatest(1e0, ceil({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 15e0)) AS st FROM pairs p JOIN nodes a ON p.u = a.node_id JOIN nodes b ON p.v = b.node_id),
net AS MATERIALIZED (SELECT DISTINCT way_id, floor((lat1 + (lat2 - lat1) * k / st) / {CELL})::BIGINT AS ci, floor((lon1 + (lon2 - lon1) * k / st) / {CELL})::BIGINT AS cj FROM (SELECT *, unnest(range(0, st::BIGINT + 1)) AS k FROM pieces)),
c AS MATERIALIZED (SELECT DISTINCT polygon_id, ci, cj FROM own JOIN net USING (way_id)), done AS MATERIALIZED (SELECT ci, cj, (ci + 0.5e0) * {CELL} AS lat, (cj + 0.5e0) * {CELL} AS lon FROM (SELECT DISTINCT ci, cj FROM cells) SEMI JOIN c USING (ci, cj)),
ridden_in AS (SELECT polygon_id, ci, cj FROM corners JOIN done ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0e0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
t AS (SELECT polygon_id, count(*) AS total FROM c GROUP BY 1), r AS (SELECT polygon_id, count(*) AS ridden FROM ridden_in SEMI JOIN c USING (polygon_id, ci, cj) GROUP BY 1),
a AS (SELECT polygon_id, count(*) AS activities FROM (SELECT polygon_id, activity_id FROM corners JOIN centers ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0e0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1),
city AS (SELECT s_suppkey AS polygon_id, coalesce(activities, 0) AS activities, round(coalesce(ridden, 0) * 15e0 / 1609.344e0, 6) AS ridden_mi, round(coalesce(total, 0) * 15e0 / 1609.344e0, 6) AS total_mi, round(CASE WHEN total > 0 THEN coalesce(ridden, 0) * 100e0 / total ELSE 0 END, 6) AS pct
FROM supplier LEFT JOIN t ON s_suppkey = t.polygon_id LEFT JOIN r ON s_suppkey = r.polygon_id LEFT JOIN a ON s_suppkey = a.polygon_id)"""


def city_coverage(d: Domain) -> DataFrame:
    """Of each city (polygon): activities with their centre in it, miles of its ways (those with their middle vertex in it, whatever their class),
    how many of those were ridden within it, and the share; a city without a polygon or ways has zeros. Polygons with the same ring are
    answered once, only ways that some polygon owns are cut, and so is a leg that many traces share."""
    rings = graph.saved(d.rings.groupBy("ring").agg(F.min("polygon_id").alias("polygon_id")))
    lines = d.way_nodes.join(d.nodes, "node_id")
    middle = lines.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("line")).where(F.size("line") >= 2)
    middle = middle.select("way_id", F.element_at("line", F.floor(F.size("line") / 2).cast("int") + 1).alias("m")).select("way_id", "m.lat", "m.lon")
    own = graph.saved(areas.points_in_polygons(middle, rings, ["way_id"]))
    pieces = elements.segments_of(lines.join(own.select("way_id").distinct(), "way_id", "left_semi").select("way_id", "pos", "node_id", "lat", "lon"))
    length = geo.haversine_m(*map(F.col, coverage.ENDS))
    steps = pieces.select(F.col("way_id").alias("activity_id"), F.col("way_id").alias("athlete_id"), F.col("lat1").alias("lat0"), F.col("lon1").alias("lon0"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"), length.alias("leg_m"))
    net = coverage.cells(steps).select(F.col("activity_id").alias("way_id"), "ci", "cj")
    held = graph.saved(own.join(net, "way_id").select("polygon_id", "ci", "cj").distinct())
    went = d.points.join(graph.saved(moving(d).select("activity_id")), "activity_id", "left_semi")
    done = coverage.shared_cells(coverage.legs(went)).join(held.select("ci", "cj").distinct(), ["ci", "cj"], "left_semi")
    done = done.select("ci", "cj", geo.cell_center(F.col("ci")).alias("lat"), geo.cell_center(F.col("cj")).alias("lon"))
    within = areas.points_in_polygons(done, rings, ["ci", "cj"]).join(held, ["polygon_id", "ci", "cj"], "left_semi")
    near = areas.points_in_polygons(areas.centers(went), rings, ["activity_id"])
    count = lambda rows, name: rows.groupBy("polygon_id").agg(F.count("*").alias(name))
    one = rings
    for rows, name in ((near, "activities"), (held, "total"), (within, "ridden")):
        one = one.join(count(rows, name), "polygon_id", "left")
    out = d.rings.join(one.drop("polygon_id"), "ring", "left").na.fill(0, ["activities", "total", "ridden"])
    pct = F.when(F.col("total") > 0, F.col("ridden") * 100.0 / F.col("total")).otherwise(0.0)
    mi = lambda c: F.col(c) * geo.CELL_M / geo.MILE_M
    return out.select("polygon_id", "activities", r6(mi("ridden"), "ridden_mi"), r6(mi("total"), "total_mi"), r6(pct, "pct"))


query("city_coverage", f"{_CITY} SELECT * FROM city")(city_coverage)
query("cities_by_percent", f"{_CITY} SELECT polygon_id, least(pct, 100) AS pct, row_number() OVER (ORDER BY pct DESC, polygon_id) AS place FROM city")(lambda d: areas.numbered(city_coverage(d).select("polygon_id", "pct"), [F.desc("pct"), F.col("polygon_id")], "place").select("polygon_id", F.least("pct", F.lit(100.0)).alias("pct"), "place"))
