"""Routes: profiles, turns, gaps, runs, markers, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators.graph import saved

#: What stands behind a document's number and behind a document: signs that no XML text holds.
FIELD, RECORD = "\x1f", "\x1e"


def cumulative_profile(legs: DataFrame) -> DataFrame:
    """Running miles (two decimals) and feet (whole)."""
    w = W.partitionBy("activity_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    turf = geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), geo.EARTH_TURF_M)
    miles = F.sum(F.coalesce(turf, F.lit(0.0))).over(w) / geo.MILE_M
    return legs.select("activity_id", "seq", geo.half_up(miles, 2).alias("distance_mi"), geo.half_up(F.col("ele") * geo.FOOT).alias("elevation_ft"))


def downsample(legs: DataFrame, per_mile: float = 200, least: int = 50, most: int = 2000) -> DataFrame:
    """`per_mile` samples a mile, `least` to `most` and no more than there are points, evenly by index."""
    n = legs.groupBy("activity_id").agg(F.count("*").alias("len"), (F.sum("leg_m") / geo.MILE_M).alias("mi"))
    want = F.least(F.col("len"), F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.coalesce("mi", F.lit(0.0)) * per_mile + 0.5))))
    picks = n.select("activity_id", "len", want.cast("bigint").alias("want")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("want") - 1)))
    index = F.floor(F.col("i") * (F.col("len") - 1) / F.greatest(F.col("want") - 1, F.lit(1)) + 0.5) + 1
    return legs.join(picks.select("activity_id", index.cast("bigint").alias("seq"), "i"), ["activity_id", "seq"])


def spread(samples: DataFrame, points: DataFrame) -> DataFrame:
    """activity_id, seq, ele of all points (seq from 1), from evenly spread samples (i from 0, ele): vertex k lies at sample k / step, between two."""
    count = samples.groupBy("activity_id").agg(F.count("*").alias("m"))
    size = points.groupBy("activity_id").agg(F.count("*").alias("n"))
    step = (F.col("n") - 1) / F.nullif(F.col("m") - 1, F.lit(0))
    at = F.coalesce((F.col("seq") - 1) / F.nullif(step, F.lit(0.0)), F.lit(0.0))
    rows = points.join(count, "activity_id").join(size, "activity_id").select("activity_id", "seq", "m", at.alias("at"))
    last = F.col("m") - 1
    rows = rows.select("activity_id", "seq", (F.col("at") - F.floor("at")).alias("t"), F.least(F.floor("at"), last).alias("lo"), F.least(F.floor("at") + 1, last).alias("hi"))
    one = lambda i, e: samples.select("activity_id", F.col("i").alias(i), F.col("ele").alias(e))
    both = rows.join(one("lo", "a"), ["activity_id", "lo"]).join(one("hi", "b"), ["activity_id", "hi"])
    return both.select("activity_id", "seq", (F.col("a") * (1 - F.col("t")) + F.col("b") * F.col("t")).alias("ele"))


def climbs(legs: DataFrame) -> DataFrame:
    """activity_id, up, down (unknown elevations are 0), up_known, down_known (unknown ones are passed over; 0 where all are)."""
    before = F.last("ele", ignorenulls=True).over(W.partitionBy("activity_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = legs.select("activity_id", "seq", "ele", "ele0", before.alias("known")).where("seq > 1")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gain = lambda a, b: F.sum(F.greatest(a - b, F.lit(0.0)))
    known = lambda a, b: F.sum(F.when(F.col("ele").isNotNull() & F.col("known").isNotNull(), F.greatest(F.col(a) - F.col(b), F.lit(0.0))).otherwise(0.0))
    return rows.groupBy("activity_id").agg(gain(zero("ele"), zero("ele0")).alias("up"), gain(zero("ele0"), zero("ele")).alias("down"), known("ele", "known").alias("up_known"), known("known", "ele").alias("down_known"))


def junctions(turns: DataFrame, angle: float = 45.0, margin: int = 3) -> DataFrame:
    """Every vertex (seq from 1) with the nearest vertices `before` and `after` it that turn by more than `angle`, not among the first ones
    (before) or last ones (after) of the route, whose ends stand in where there is none."""
    w = W.partitionBy("activity_id").orderBy("seq")
    rows = turns.withColumn("n", F.max("seq").over(W.partitionBy("activity_id")))
    sharp = F.col("turn") > angle
    before = F.max(F.when(sharp & (F.col("seq") > margin), F.col("seq"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(sharp & (F.col("seq") <= F.col("n") - margin), F.col("seq"))).over(w.rowsBetween(1, W.unboundedFollowing))
    return rows.select("activity_id", "seq", "turn", F.coalesce(before, F.lit(1)).cast("bigint").alias("before"), F.coalesce(after, "n").cast("bigint").alias("after"))


def turn(legs: DataFrame) -> DataFrame:
    """Points with the angle turned there; null at the ends."""
    b1 = geo.bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    b2 = geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return legs.withColumn("turn", geo.angle_diff(b1, b2))


def runs(points: DataFrame, flag: str) -> DataFrame:
    """Alternating runs of one value of `flag`."""
    w = W.partitionBy("activity_id").orderBy("seq")
    changed = F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(0))
    tagged = points.select("activity_id", "seq", flag, changed.alias("c"))
    numbered = tagged.withColumn("run", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("activity_id", "run", flag).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def marker_candidates(legs: DataFrame, scale: float = 1.0) -> DataFrame:
    """A marker each 400 m from 200 m on, with the bearing of its leg."""
    w = W.partitionBy("activity_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = legs.where("leg_m > 0").withColumn("end", F.sum("leg_m").over(w)).withColumn("start", F.col("end") - F.col("leg_m"))
    step = 400.0 * scale
    lo, hi = F.ceil((F.col("start") - step / 2) / step), F.ceil((F.col("end") - step / 2) / step) - 1
    lo = F.greatest(lo, F.lit(0))
    cut = rows.withColumn("lo", lo).withColumn("hi", hi).where("hi >= lo").withColumn("n", F.explode(F.sequence("lo", "hi")))
    t = (F.col("n") * step + step / 2 - F.col("start")) / F.col("leg_m")
    return cut.select(
        "activity_id", "n", (F.col("lat0") + (F.col("lat") - F.col("lat0")) * t).alias("lat"), (F.col("lon0") + (F.col("lon") - F.col("lon0")) * t).alias("lon"),
        geo.bearing_deg(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")).alias("angle"),
    )


def thin_markers(markers: DataFrame, scale: float = 1.0) -> DataFrame:
    """Markers that a first-come pass would keep, none within 200 m of a kept one in the 3 x 3 cells around; found in rounds:
    whoever has no undecided marker before it is kept, and those near it fall."""
    size = 200.0 * scale / geo.DEGREE_M
    m = saved(markers.withColumn("ci", geo.cell(F.col("lat"), size)).withColumn("cj", geo.cell(F.col("lon"), size)))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    wide = m.select("activity_id", F.col("n").alias("n0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "ci", "cj").withColumn("x", around).withColumn("y", around)
    wide = wide.select("activity_id", "n0", "lat0", "lon0", (F.col("ci") + F.col("x")).alias("ci"), (F.col("cj") + F.col("y")).alias("cj"))
    near = geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) < 200.0 * scale
    before = saved(m.join(wide, ["activity_id", "ci", "cj"]).where((F.col("n0") < F.col("n")) & near).select("activity_id", "n", "n0"))
    undecided, kept = saved(m.select("activity_id", "n")), None
    while not undecided.isEmpty():
        blocked = before.join(undecided.withColumnRenamed("n", "n0"), ["activity_id", "n0"]).select("activity_id", "n").distinct()
        fresh = saved(undecided.join(blocked, ["activity_id", "n"], "left_anti"))
        kept = fresh if kept is None else kept.union(fresh)
        fallen = before.join(fresh.withColumnRenamed("n", "n0"), ["activity_id", "n0"]).select("activity_id", "n").distinct()
        undecided = saved(undecided.join(fresh, ["activity_id", "n"], "left_anti").join(fallen, ["activity_id", "n"], "left_anti"))
    return m.drop("ci", "cj") if kept is None else m.join(kept, ["activity_id", "n"], "left_semi").drop("ci", "cj")


def encode_polyline(points: DataFrame) -> DataFrame:
    """(activity_id, polyline): five decimals, differences, zig-zag, groups of five bits."""
    w = W.partitionBy("activity_id").orderBy("seq")
    y, x = geo.half_up(F.col("lat") * 1e5).cast("bigint"), geo.half_up(F.col("lon") * 1e5).cast("bigint")
    rows = points.select("activity_id", "seq", y.alias("y"), x.alias("x"))
    rows = rows.select("activity_id", "seq", *((F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in ("y", "x")))

    def code(d: Column) -> Column:
        z = F.when(d < 0, -2 * d - 1).otherwise(2 * d)
        parts = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: (k == 0) | (F.floor(z / F.pow(F.lit(32.0), k)) > 0))
        return F.array_join(F.transform(parts, lambda k: F.char(F.floor(z / F.pow(F.lit(32.0), k)) % 32 + F.when(k < F.size(parts) - 1, 32).otherwise(0) + 63)), "")

    text = F.concat(code(F.col("y")), code(F.col("x")))
    return rows.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("a")).select("activity_id", F.array_join(F.transform("a", lambda s: s["t"]), "").alias("polyline"))


def decode_polyline(lines: DataFrame) -> DataFrame:
    """(activity_id, seq, lat, lon) by built-ins only."""
    g = lines.select("activity_id", F.posexplode(F.regexp_extract_all("polyline", F.lit("([_-~]*[?-^])"), F.lit(1))).alias("i", "tok"))
    digits = F.transform(F.sequence(F.length("tok"), F.lit(1), F.lit(-1)), lambda k: (F.ascii(F.substring(F.col("tok"), k, F.lit(1))) - 63) % 32)
    z = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, x: acc * 32 + x)
    delta = F.when(z % 2 == 1, -(z + 1) / 2).otherwise(z / 2).cast("bigint")
    rows = g.select("activity_id", (F.floor(F.col("i") / 2) + 1).alias("seq"), (F.col("i") % 2).alias("axis"), delta.alias("d"))
    w = W.partitionBy("activity_id", "axis").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.withColumn("s", F.sum("d").over(w) / 1e5)
    return sums.groupBy("activity_id", "seq").agg(F.max(F.when(F.col("axis") == 0, F.col("s"))).alias("lat"), F.max(F.when(F.col("axis") == 1, F.col("s"))).alias("lon"))


def verbatim(c: str) -> Column:
    """A number as its shortest text, without a fraction of zero."""
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def gpx(points: DataFrame, name: Column | None = None) -> DataFrame:
    """(activity_id, gpx): one document for each route, numbers verbatim, elevation left out where unknown."""
    name = geo.xml_escape(F.lit("Course") if name is None else name)
    ele = F.coalesce(F.concat(F.lit("<ele>"), verbatim("ele"), F.lit("</ele>")), F.lit(""))
    tag = F.concat(F.lit('<trkpt lat="'), verbatim("lat"), F.lit('" lon="'), verbatim("lon"), F.lit('">'), ele, F.lit("</trkpt>"))
    rows = points.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("seq", tag.alias("t")))).alias("a"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="kerbline" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>'
    body = F.array_join(F.transform("a", lambda s: s["t"]), "\n")
    return rows.select("activity_id", F.concat(F.lit(head), name, F.lit("</name></metadata><trk><name>"), name, F.lit("</name><trkseg>\n"), body, F.lit("\n</trkseg></trk></gpx>")).alias("gpx"))


def tcx(legs: DataFrame, name: Column | None = None, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """(activity_id, tcx): one course for each route; a second a point from `start`, distance so far and altitude to two decimals."""
    name = geo.xml_escape(F.lit("Course") if name is None else name)
    w = W.partitionBy("activity_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    row = legs.withColumn("m", F.sum(F.coalesce("leg_m", F.lit(0.0))).over(w)).withColumn("i", F.row_number().over(W.partitionBy("activity_id").orderBy("seq")))
    place = F.concat(F.lit("<LatitudeDegrees>"), verbatim("lat"), F.lit("</LatitudeDegrees><LongitudeDegrees>"), verbatim("lon"), F.lit("</LongitudeDegrees>"))
    time = F.date_format(F.to_timestamp(F.lit(start)) + F.make_dt_interval(secs=F.col("i") - 1), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.concat(F.lit("<Trackpoint><Time>"), time, F.lit("</Time><Position>"), place, F.format_string("</Position><AltitudeMeters>%.2f</AltitudeMeters><DistanceMeters>%.2f</DistanceMeters></Trackpoint>", F.coalesce("ele", F.lit(0.0)), F.col("m")))
    a = row.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("seq", point.alias("t"), place.alias("p")))).alias("a"), F.count("*").alias("n"), F.max("m").alias("m"))
    lap = F.concat(
        F.format_string("<Lap><TotalTimeSeconds>%d</TotalTimeSeconds><DistanceMeters>%.2f</DistanceMeters><BeginPosition>", "n", "m"), F.get("a", F.lit(0))["p"],
        F.lit("</BeginPosition><EndPosition>"), F.element_at("a", -1)["p"], F.lit("</EndPosition><Intensity>Active</Intensity></Lap>"),
    )
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Courses><Course><Name>'
    track = F.array_join(F.transform("a", lambda s: s["t"]), "\n")
    return a.select("activity_id", F.concat(F.lit(head), name, F.lit("</Name>"), lap, F.lit("<Track>\n"), track, F.lit("\n</Track></Course></Courses></TrainingCenterDatabase>")).alias("tcx"))


def geojson(points: DataFrame) -> DataFrame:
    """(activity_id, feature): a LineString of [lon, lat, elevation, construction]."""
    pair = F.array("lon", "lat", F.coalesce("ele", F.lit(0.0)), F.col("construction").cast("double"))
    rows = points.groupBy("activity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", pair.alias("p")))), lambda s: s["p"]).alias("coordinates"))
    return rows.select("activity_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"))).alias("feature"))


def write_files(documents: DataFrame, column: str, path: str) -> None:
    """Text files of many documents each, so that millions of routes are no millions of files: every document stands whole
    behind its activity_id and FIELD, and ends with RECORD. XML allows neither sign."""
    own = F.concat(F.col("activity_id").cast("string"), F.lit(FIELD), F.col(column))
    documents.select(own.alias("value")).write.option("lineSep", RECORD).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the documents below `path`, each whole; file is its activity_id."""
    rows = spark.read.option("lineSep", RECORD).text(path)
    at = F.instr("value", FIELD)
    return rows.select(F.substring("value", F.lit(1), at - 1).cast("bigint").alias("file"), F.substring("value", at + 1, F.length("value")).alias("value"))


def parse_tracks(files: DataFrame) -> DataFrame:
    """(file, seq, lat, lon, ele) from GPX or TCX texts (file, value): track points, else route points, else course points; attributes
    in either order; two points at least."""
    found = [F.regexp_extract_all("value", F.lit(rx), F.lit(1)) for rx in (r"(?s)(<trkpt\b.*?</trkpt>|<trkpt\b[^>]*/>)", r"(?s)(<rtept\b.*?</rtept>|<rtept\b[^>]*/>)", r"(?s)(<Trackpoint\b.*?</Trackpoint>)")]
    tags = F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])
    rows = files.select("file", tags.alias("tags")).where(F.size("tags") >= 2).select("file", F.posexplode("tags").alias("i", "tag"))
    one = lambda rx: F.nullif(F.regexp_extract("tag", rx, 1), F.lit("")).try_cast("double")
    num = lambda a, b: F.coalesce(one(a), one(b))
    return rows.select(
        "file", (F.col("i") + 1).alias("seq"), num(r'\blat="([^"]*)"', "<LatitudeDegrees>([^<]*)<").alias("lat"),
        num(r'\blon="([^"]*)"', "<LongitudeDegrees>([^<]*)<").alias("lon"), num("<ele>([^<]*)</ele>", "<AltitudeMeters>([^<]*)<").alias("ele"),
    )
