"""Snapping: nearest nodes and segments, cells around points, drawn routes and what they cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import search
from kerbline.operators.graph import saved

#: First cell size in degrees, and by how much it grows for points with nothing near; above FLAT the bound on what lies outside the
#: ring would not hold, so WORLD follows, whose ring holds everything.
FIRST, GROWTH, FLAT, WORLD = 0.002, 4.0, 8.0, 360.0


def samples(size: float) -> Column:
    """Cells of a segment, found at steps of half a cell at most."""
    dlat, dlon = F.col("lat2") - F.col("lat1"), F.col("lon2") - F.col("lon1")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dlat), F.abs(dlon)) / (size / 2)))
    at = lambda a, d, k: F.floor((F.col(a) + d * k / steps) / size)
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint")), lambda k: F.struct(at("lat1", dlat, k).alias("ci"), at("lon1", dlon, k).alias("cj"))))


def node_cells(nodes: DataFrame, size: float) -> DataFrame:
    return nodes.select("*", geo.cell(F.col("lat"), size).alias("ci"), geo.cell(F.col("lon"), size).alias("cj"))


def segment_cells(segments: DataFrame, size: float) -> DataFrame:
    return segments.withColumn("c", F.explode(samples(size))).select("*", "c.ci", "c.cj").drop("c")


def around(points: DataFrame, size: float, k: int = 1) -> DataFrame:
    """Points (qlat, qlon) with every cell within k of theirs."""
    ring = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    wide = points.withColumn("di", ring).withColumn("dj", ring)
    return wide.withColumn("ci", geo.cell(F.col("qlat"), size) + F.col("di")).withColumn("cj", geo.cell(F.col("qlon"), size) + F.col("dj")).drop("di", "dj")


def nearest(points: DataFrame, keys: list[str], cells: Callable[[float], DataFrame], best: Column, sure: float) -> DataFrame:
    """For each point the least `best` (a struct that begins with metres) in the 3 x 3 cells around it, if that is within `sure`
    cells, so that nothing outside can be nearer; other points look again in larger cells. Points without any candidate go. Cells do not join at 180 degrees east."""
    size, out, rest = FIRST, None, saved(points)
    while not rest.isEmpty():
        found = around(rest, size).join(cells(size), ["ci", "cj"]).groupBy(*keys, "qlat").agg(F.min(best).alias("x"))
        near = F.col("x.m") <= sure * size * geo.DEGREE_M * F.cos(F.radians("qlat"))
        done = saved((found.where(near) if size < WORLD else found).select(*keys, "x"))
        out = done if out is None else out.union(done)
        if size >= WORLD:
            break
        rest, size = saved(rest.join(done, keys, "left_anti")), size * GROWTH if size < FLAT else WORLD
    return out if out is not None else points.join(cells(FIRST), F.lit(False)).select(*keys, best.alias("x"))


def nearest_node(points: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """keys, node_id, m: ties (to a millimetre) by smallest id."""
    m = F.round(geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")), 3)
    x = nearest(points, keys, lambda size: node_cells(nodes.select("node_id", "lat", "lon"), size), F.struct(m.alias("m"), "node_id"), 0.99)
    return x.select(*keys, "x.node_id", "x.m")


def nearest_edge(points: DataFrame, keys: list[str], segments: DataFrame) -> DataFrame:
    """keys, way_id, pos, u, v, the snapped point and m, among segments that are not avoided; ties by way and place."""
    t, y, x = geo.project(F.col("qlat"), F.col("qlon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    m = F.round(geo.haversine_m(F.col("qlat"), F.col("qlon"), y, x), 3)
    s = segments.where(~F.col("is_avoided")).select("way_id", "pos", "u", "v", "lat1", "lon1", "lat2", "lon2")
    best = F.struct(m.alias("m"), "way_id", "pos", "u", "v", y.alias("lat"), x.alias("lon"), t.alias("t"))
    return nearest(points, keys, lambda size: segment_cells(s, size), best, 0.5).select(*keys, "x.*")


def nodes_within(points: DataFrame, keys: list[str], segments: DataFrame, size: float, k: int) -> DataFrame:
    """keys, node_id: ends of the segments that stand in a cell within k of the point's."""
    s = segment_cells(segments.select("u", "v", "lat1", "lon1", "lat2", "lon2"), size).select("ci", "cj", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return around(points, size, k).join(s, ["ci", "cj"]).select(*keys, "node_id").distinct()


def steps_of(drawn: DataFrame, nodes: DataFrame) -> DataFrame:
    """route_id, k, a, b: consecutive nodes of drawn routes (route_id, k, qlat, qlon) snapped to their nearest nodes; a step between equal points is none."""
    near = saved(nearest_node(drawn, ["route_id", "k"], nodes))
    snapped = near.join(drawn.select("route_id", "k", "qlat", "qlon"), ["route_id", "k"])
    after = snapped.select("route_id", (F.col("k") - 1).alias("k"), F.col("node_id").alias("b"), F.col("qlat").alias("lat2"), F.col("qlon").alias("lon2"))
    steps = snapped.select("route_id", "k", F.col("node_id").alias("a"), "qlat", "qlon").join(after, ["route_id", "k"])
    return steps.where("qlat <> lat2 or qlon <> lon2").select("route_id", "k", "a", "b")


def traversal_penalties(drawn: DataFrame, nodes: DataFrame, segments: DataFrame, ridden: DataFrame, traversed: float = 5.0, known: float = 15.0) -> DataFrame:
    """route_id, way_id, pos, multiplier of every segment on a drawn route; a ridden one costs both factors."""
    pairs = steps_of(drawn, nodes).where("a <> b").select("route_id", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    s = segments.select("way_id", "pos", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    hit = pairs.join(s, ["p", "q"]).join(ridden.select("way_id", "pos", F.lit(known).alias("r")), ["way_id", "pos"], "left")
    return hit.select("route_id", "way_id", "pos", (F.lit(traversed) * F.coalesce("r", F.lit(1.0))).alias("multiplier"))


def vertices(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Nodes that a segment of the network ends at."""
    return nodes.join(segments.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi")


def required_from_route(drawn: DataFrame, nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """route_id, k, way_id, pos, how: the segments that the steps of drawn routes take.

    A step between the two ends of a segment takes it (`direct`, avoided ones as well), another one the segments of a cheapest way
    between its ends (`path`, by weight to a hundredth of a millimetre); a step whose ends snap to the same node takes the segment that both drawn points lie nearest to
    (`same`). Of parallel segments the smallest way counts. Steps between equal points are passed over.
    """
    steps = saved(steps_of(drawn, nodes))
    s = saved(segments.groupBy(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).agg(F.min(F.struct("way_id", "pos")).alias("s"), F.min(F.round(F.col("weight") * 1e5)).alias("w")))
    ends = [F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")]
    apart = steps.where("a <> b").select("route_id", "k", "a", "b", *ends)
    direct = apart.join(s, ["p", "q"]).select("route_id", "k", "s.way_id", "s.pos", F.lit("direct").alias("how"))
    # Each distinct pair of ends is searched once, whichever way it is walked, in a network that is one area.
    gaps = saved(apart.join(s, ["p", "q"], "left_anti").select("route_id", "k", "p", "q"))
    want = saved(gaps.select("p", "q").distinct().withColumn("r", F.monotonically_increasing_id()))
    whole = F.lit(0).cast("bigint").alias("area_id")
    walk = saved(search.between(s.select(whole, F.col("p").alias("u"), F.col("q").alias("v"), "w"), want.select("r", whole, F.col("p").alias("s"), F.col("q").alias("t")), delta=search.DELTA * 1e5))
    after = walk.select("r", (F.col("k") - 1).alias("k"), F.col("node_id").alias("b"))
    hops = walk.select("r", "k", F.col("node_id").alias("a")).join(after, ["r", "k"]).select("r", *ends).join(s, ["p", "q"]).select("r", "s.way_id", "s.pos")
    path = gaps.join(want, ["p", "q"]).join(hops, "r").select("route_id", "k", "way_id", "pos", F.lit("path").alias("how"))
    short = steps.where("a = b").select("route_id", "k")
    spots = short.select("route_id", F.explode(F.array("k", F.col("k") + 1)).alias("k")).distinct()
    edge = saved(nearest_edge(drawn.join(spots, ["route_id", "k"], "left_semi"), ["route_id", "k"], segments).select("route_id", "k", "way_id", "pos"))
    after = edge.select("route_id", (F.col("k") - 1).alias("k"), "way_id", "pos")
    same = short.join(edge, ["route_id", "k"]).join(after, ["route_id", "k", "way_id", "pos"])
    return direct.union(path).union(same.select("route_id", "k", "way_id", "pos", F.lit("same").alias("how")))


def shared_run(bridges: DataFrame, paths: DataFrame) -> DataFrame:
    """route_id, n: vertices before the junction at which a bridge only runs back along the path that follows. Both are
    (route_id, seq, lat, lon); the bridge ends where the path starts. Compared to six decimals, less than either length."""
    def counted(rows: DataFrame, back: bool) -> DataFrame:
        ends = rows.groupBy("route_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        k = F.col("hi") - F.col("seq") if back else F.col("seq") - F.col("lo")
        at = F.struct(F.round("lat", 6).alias("y"), F.round("lon", 6).alias("x"))
        return rows.join(ends, "route_id").select("route_id", k.alias("k"), at.alias("at"), (F.col("hi") - F.col("lo")).alias("most"))

    a, b = counted(bridges, True), counted(paths, False)
    both = a.join(b.select("route_id", "k", F.col("at").alias("other"), F.col("most").alias("most2")), ["route_id", "k"])
    ends = both.groupBy("route_id").agg(F.min(F.when((F.col("k") > 0) & (F.col("at") != F.col("other")), F.col("k"))).alias("bad"), F.min(F.least("most", "most2")).alias("most"))
    return ends.select("route_id", F.coalesce(F.col("bad") - 1, "most").alias("n"))


def natural_endpoint(points: DataFrame, degrees: DataFrame, nodes: DataFrame, reach: float = 400.0) -> DataFrame:
    """area_id, node_id, odd: the nearest odd node of the area within reach, else its nearest node."""
    c = degrees.join(nodes, "node_id").join(points, "area_id")
    m = F.round(geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")), 3)
    x = F.struct(m.alias("m"), "node_id")
    best = c.groupBy("area_id").agg(F.min(F.when((F.col("degree") % 2 == 1) & (m <= reach), x)).alias("o"), F.min(x).alias("any"))
    return best.select("area_id", F.coalesce("o.node_id", "any.node_id").alias("node_id"), F.col("o").isNotNull().alias("odd"))
