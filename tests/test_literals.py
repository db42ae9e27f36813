"""Known small cases."""

import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import activities, areas, coverage, graph, routes
from kerbline.plans import catalog


def trace(spark, points, activity=1):
    schema = "activity_id bigint, athlete_id bigint, seq bigint, lat double, lon double, ele double, construction boolean"
    return spark.createDataFrame([(activity, 1, i + 1, float(a), float(b), None, False) for i, (a, b) in enumerate(points)], schema)


def test_polyline(spark):
    line = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@")], "activity_id bigint, polyline string")
    got = [(r["lat"], r["lon"]) for r in routes.decode_polyline(line).orderBy("seq").collect()]
    assert got == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


@pytest.mark.parametrize(
    "text, plain, named",
    [("234W for the 20 min test which is 222W FTP", 222, 222), ("my FTP is way over 9000 today, felt like 40", None, None), ("held 245 watts", None, 245), ("", None, None), (None, None, None)],
)
def test_ftp(spark, text, plain, named):
    c = spark.createDataFrame([(1, 1, 1, text)], "event_id bigint, athlete_id bigint, ts bigint, text string")
    assert activities.ftp_readings(c).first()["ftp"] == plain
    assert activities.ftp_readings(c, True).first()["ftp"] == named


def test_cells_of_one_kilometre(spark):
    lon = 1000 / (geo.DEGREE_M * 0.7660444)
    one = coverage.cells(coverage.legs(trace(spark, [(40, 0), (40, lon)])))
    assert 50 < one.count() < 80
    twelve = trace(spark, [(40, 0), (40, lon)])
    for k in range(2, 13):
        twelve = twelve.union(trace(spark, [(40, 0), (40, lon)], k))
    assert coverage.cells(coverage.legs(twelve)).select("ci", "cj").distinct().count() == one.count()


def segment(spark, lat1, lon1, lat2, lon2):
    return spark.createDataFrame([(7, 0, lat1, lon1, lat2, lon2)], "way_id bigint, pos bigint, lat1 double, lon1 double, lat2 double, lon2 double")


def test_spur_jitter_and_turn(spark):
    spur = segment(spark, 47.65, -117.42, 47.65 + 20 / geo.DEGREE_M, -117.42)
    jitter = trace(spark, [(47.65, -117.4205), (47.65 + 8 / geo.DEGREE_M, -117.42 + 2 / 75000), (47.65, -117.4195)])
    turned = trace(spark, [(47.65, -117.42), (47.65 + 20 / geo.DEGREE_M, -117.42)])
    assert coverage.ridden(turned, spur).count() == 1
    assert coverage.ridden(trace(spark, [(47.66, -117.43), (47.66, -117.44)]), spur).count() == 0
    assert coverage.segment_coverage(coverage.candidates(jitter.select("lat", "lon"), spur)).where("ridden").count() == 0


def test_point_in_notched_ring(spark):
    ring = spark.sql("select 1L polygon_id, array(struct(0d lat, 0d lon), struct(0d lat, 0.06d lon), struct(0.06d lat, 0.06d lon), struct(0.03d lat, 0.03d lon), struct(0.06d lat, 0d lon)) ring")
    p = spark.createDataFrame([(1, 0.01, 0.03), (2, 0.05, 0.03), (3, 0.05, 0.059), (4, 0.2, 0.2)], "k bigint, lat double, lon double")
    assert sorted(r["k"] for r in areas.points_in_polygons(p, ring, ["k"]).collect()) == [1, 3]


def test_tracks_in_either_order(spark):
    f = spark.createDataFrame([("a", '<gpx><trkpt lon="2" lat="1"><ele>5.5</ele></trkpt><trkpt lat="3" lon="4"/></gpx>'), ("b", '<rtept lat="1" lon="1"/>')], "file string, value string")
    assert [tuple(r)[1:] for r in routes.parse_tracks(f).orderBy("seq").collect()] == [(1, 1.0, 2.0, 5.5), (2, 3.0, 4.0, None)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 1, 3, 5.0), (1, 8, 9, 1.0)], "area_id bigint, u bigint, v bigint, w double")
    assert {(r["node_id"], r["label"]) for r in graph.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    d = graph.shortest_paths(e, spark.createDataFrame([(1, 1)], "area_id bigint, node_id bigint"))
    assert {(r["node_id"], r["dist"]) for r in d.collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    pairs = spark.createDataFrame([(1, 1, 2, 5.0), (1, 2, 3, 1.0), (1, 3, 4, 2.0), (1, 1, 4, 9.0)], "area_id bigint, u bigint, v bigint, dist double")
    assert {(r["u"], r["v"]) for r in graph.mutual_pairs(pairs).collect()} == {(2, 3), (1, 4)}


def test_markers(spark):
    straight = coverage.legs(trace(spark, [(47.0, -117.0), (47.0 + 2000 / geo.DEGREE_M, -117.0)]))
    assert 4 <= routes.thin_markers(routes.marker_candidates(straight)).count() <= 6
    bounce = coverage.legs(trace(spark, [(47.0 + (20 / geo.DEGREE_M if i % 2 else 0), -117.0) for i in range(200)]))
    assert routes.thin_markers(routes.marker_candidates(bounce)).count() == 1


def test_half_up(spark):
    got = spark.range(1).select(geo.place_bucket(F.lit(-117.425)).alias("x"), geo.half_up(F.lit(-2.5)).alias("y")).first()
    assert tuple(got) == (-2348, -2.0)


def test_sketches_of_months_merge(spark):
    """The merged sketches count like one over all, near the exact number and past it in no group."""
    cells = spark.range(60_000).selectExpr("id % 3 as athlete_id", "id % 7 as month", "id % 9000 as ci", "id % 2 as cj")
    exact = {r["athlete_id"]: r["n"] for r in cells.groupBy("athlete_id").agg(F.countDistinct("ci", "cj").alias("n")).collect()}
    got = coverage.merged_cells(coverage.cell_sketches(cells, ["athlete_id", "month"]), ["athlete_id"]).collect()
    assert len(got) == 3 and all(abs(r["cells"] - exact[r["athlete_id"]]) <= 0.03 * exact[r["athlete_id"]] for r in got)


def test_scratch_tables(spark):
    """Tables go when asked for; on a cluster a machine's own folder is refused."""
    df = graph.saved(spark.range(3))
    assert df.count() == 3 and graph.drop_tables(spark) >= 1 and not graph.TABLES
    with pytest.raises(Exception):
        df.count()

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.folder(Cluster, "x")


def test_ridden_flag_near_poles(spark):
    """Streets at and beyond a pole, where a metre is many degrees wide, count like those elsewhere."""
    rows = [(k, 0, lat, lon, lat + 0.0004, lon + east) for k, (lat, lon, east) in enumerate([(47.6, -117.4, 0.001), (90.0, 10.0, 0.001), (-90.0, 10.0, 0.001), (89.999, 10.0, 0.5), (89.9, -60.0, 0.1), (-89.9, 3.0, 0.0), (107.6, 10.0, 0.0)])]
    segments = spark.createDataFrame(rows, "way_id bigint, pos bigint, lat1 double, lon1 double, lat2 double, lon2 double")
    # 20 m beside the middle of way 4, 20 m and 30 m beside that of way 5, 15 m beside that of way 0.
    off = lambda m, lat: m / geo.DEGREE_M / math.cos(math.radians(lat))
    points = trace(spark, [(89.9002, -59.95 + off(20, 89.9002)), (-89.8998, 3 + off(20, 89.8998)), (47.6002 + 10 / geo.DEGREE_M, -117.3995)])
    assert sorted(r["way_id"] for r in coverage.ridden_flag(points, segments).collect()) == [0, 4, 5]
    assert coverage.ridden_flag(trace(spark, [(-89.8998, 3 + off(30, 89.8998))]), segments).count() == 0


def test_ascent_where_no_later_elevation_is_known(spark):
    points = trace(spark, [(40, 0), (40, 1), (40, 2)]).withColumn("ele", F.when(F.col("seq") == 1, 280.0))
    got = routes.climbs(coverage.legs(points)).first()
    assert (got["up"], got["down"], got["up_known"], got["down_known"]) == (0.0, 280.0, 0.0, 0.0)


def test_track_documents_share_files(spark, tmp_path):
    """Documents with line ends stay whole, and their number does not make the number of files."""
    rows = [(k, f'<?xml version="1.0"?>\n<gpx>{k}\r\n</gpx>') for k in range(300)]
    routes.write_files(spark.createDataFrame(rows, "activity_id bigint, gpx string").coalesce(2), "gpx", str(tmp_path / "tracks"))
    assert len([p for p in (tmp_path / "tracks").rglob("*") if p.suffix == ".txt"]) <= 2
    assert sorted(map(tuple, routes.read_files(spark, str(tmp_path / "tracks")).collect())) == rows


def test_shared_legs(spark):
    """A leg that several traces share is cut once, with how often it is ridden; every trace's last point counts."""
    points = trace(spark, [(40, 0), (40, 0.001), (40, 0.002)]).union(trace(spark, [(40, 0), (40, 0.001)], 2)).union(trace(spark, [(40, 0.001), (40, 0.002)], 3))
    legs = coverage.legs(points)
    every = sorted(map(tuple, coverage.densified(legs).groupBy("lat", "lon").count().collect()))
    rows = coverage.shared_points(legs)
    assert sorted(map(tuple, rows.groupBy("lat", "lon").agg(F.sum("times")).collect())) == every
    assert rows.count() < coverage.densified(legs).count()


def test_equal_boxes_are_answered_once(spark):
    class Areas:
        boxes = spark.createDataFrame([(5, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0), (4, 0.0, 0.0, 1.0, 2.0)], "area_id bigint, south double, west double, north double, east double")

    asked = []

    def f(d):
        asked.append(sorted(r["area_id"] for r in d.boxes.collect()))
        return d.boxes.select("area_id", F.col("east").alias("x"))

    assert sorted(map(tuple, catalog.per_box(f)(Areas()).collect())) == [(3, 1.0), (4, 2.0), (5, 1.0)] and asked == [[3, 4]]
