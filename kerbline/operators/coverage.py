"""Traces: legs, densified points, coverage cells; map-matching to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators.graph import saved

TOLERANCE_M, COVERED_M, STRIDE_M, GRID, SPAN = 20.0, 11.0, 12.0, 0.005, 0.6
FLAG_M, FLAG_GRID = 25.0, 0.0005
#: Segments that a cell of the matching holds at most, and how often it is cut for that: cells of 17 m, less than the tolerance.
MOST_SEGMENTS, DEPTH = 16, 5
ENDS = ("lat1", "lon1", "lat2", "lon2")


def legs(points: DataFrame) -> DataFrame:
    """Each point with the one before and after it, and the metres from the one before."""
    w = W.partitionBy("activity_id").orderBy("seq")
    rows = points.select(
        "activity_id", "athlete_id", "seq", "lat", "lon", "ele", "construction", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"),
        F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), F.lag("ele").over(w).alias("ele0"),
    )
    return rows.withColumn("leg_m", geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))


def cells(legs_: DataFrame) -> DataFrame:
    """Distinct 15 m cells of each activity, over traces cut into steps of 15 m at most."""
    steps = F.greatest(F.lit(1), F.ceil(F.col("leg_m") / geo.CELL_M).cast("int"))
    cut = legs_.where("lat0 is not null").withColumn("st", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("st"))))
    lat = F.col("lat0") + (F.col("lat") - F.col("lat0")) * F.col("k") / F.col("st")
    lon = F.col("lon0") + (F.col("lon") - F.col("lon0")) * F.col("k") / F.col("st")
    return cut.select("activity_id", "athlete_id", geo.cell(lat).alias("ci"), geo.cell(lon).alias("cj")).distinct()


def shared_cells(legs_: DataFrame) -> DataFrame:
    """(ci, cj): the cells that any trace has; a leg that many traces share is cut once."""
    one = legs_.select("lat0", "lon0", "lat", "lon", "leg_m").distinct()
    return cells(one.select(F.lit(0).alias("activity_id"), F.lit(0).alias("athlete_id"), "*")).select("ci", "cj")


def cell_sketches(cells_: DataFrame, by: list[str], bits: int = 14) -> DataFrame:
    """A sketch of the distinct cells (ci, cj) of each group. Sketches of 2^bits counters are a few KB whatever they hold, err by about
    1.04 / sqrt(2^bits), 0.8 % with 14, and are merged by merged_cells(), so those of past months need not be built again."""
    return cells_.groupBy(*by).agg(F.hll_sketch_agg(F.xxhash64("ci", "cj"), bits).alias("sketch"))


def merged_cells(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The groups' sketches as one for each wider group, and about how many cells it holds."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("cells", F.hll_sketch_estimate("sketch"))


def densified(legs_: DataFrame, *more: str) -> DataFrame:
    """Trace points with more between them, one each 12 m."""
    dy = (F.col("lat") - F.col("lat0")) * geo.DEGREE_M
    dx = (F.col("lon") - F.col("lon0")) * geo.DEGREE_M * F.cos(F.radians("lat0"))
    st = F.greatest(F.lit(1), F.floor(F.sqrt(dy * dy + dx * dx) / STRIDE_M).cast("int"))
    cut = legs_.where("lat0 is not null").withColumn("st", st).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("st") - 1)))
    inner = cut.select(
        "activity_id", (F.col("lat0") + (F.col("lat") - F.col("lat0")) * F.col("k") / F.col("st")).alias("lat"), (F.col("lon0") + (F.col("lon") - F.col("lon0")) * F.col("k") / F.col("st")).alias("lon"), *more
    )
    return inner.union(legs_.where("lat2 is null").select("activity_id", "lat", "lon", *more))


def shared_points(legs_: DataFrame) -> DataFrame:
    """(lat, lon, times): the points of densified(), a leg that many traces share cut once, with how often it is ridden."""
    own = ["lat0", "lon0", "lat", "lon", "lat2"]
    ends = F.when(F.col("lat2").isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias("lat2")
    one = legs_.select(F.lit(0).alias("activity_id"), *own[:4], ends).groupBy("activity_id", *own).agg(F.count("*").alias("times"))
    return densified(one, "times").select("lat", "lon", "times")


def match_cells(segments: DataFrame, tolerance: float = TOLERANCE_M, most: int = MOST_SEGMENTS) -> DataFrame:
    """way_id, pos, ends, level, ci, cj: the cells in which points can be near a segment, each with `most` segments at most.

    A segment counts in the coarse cells of its ends and middle alone. Each of those holds the part of the segment's box, widened by the
    tolerance, that lies in it, and is cut in four as long as it holds too many segments (as far as DEPTH levels: then they lie within the tolerance of each other).
    """
    pad = tolerance * 1.002 / geo.DEGREE_M
    wide = pad / F.cos(F.radians(F.least(F.greatest(F.abs("lat1"), F.abs("lat2")) + pad, F.lit(89.9))))
    spot = lambda y, x: F.struct(geo.cell(y, GRID).alias("i"), geo.cell(x, GRID).alias("j"))
    spots = F.array_distinct(F.array(spot(F.col("lat1"), F.col("lon1")), spot(F.col("lat2"), F.col("lon2")), spot((F.col("lat1") + F.col("lat2")) / 2, (F.col("lon1") + F.col("lon2")) / 2)))
    box = [(F.least("lat1", "lat2") - pad) / GRID, (F.greatest("lat1", "lat2") + pad) / GRID, (F.least("lon1", "lon2") - wide) / GRID, (F.greatest("lon1", "lon2") + wide) / GRID]
    rows = segments.select("way_id", "pos", *ENDS, *(c.alias(n) for c, n in zip(box, ("s", "n", "w", "e"))), F.explode(spots).alias("c"))
    now = saved(rows.select("*", F.col("c.i").alias("ci"), F.col("c.j").alias("cj")).drop("c"))
    out = None
    for level in range(DEPTH + 1):
        full = now.groupBy("ci", "cj").agg(F.count("*").alias("held")).where(F.col("held") > (most if level < DEPTH else F.lit(1 << 62))).select("ci", "cj")
        done = now.join(full, ["ci", "cj"], "left_anti").select("way_id", "pos", *ENDS, F.lit(level).alias("level"), "ci", "cj")
        out = done if out is None else out.union(done)
        # Halves of a cell are numbered 2 i and 2 i + 1, so a point's cell at any level is found by the same floor.
        twice = float(2 ** (level + 1))
        half = F.explode(F.array(F.lit(0), F.lit(1)))
        cut = now.join(full, ["ci", "cj"], "left_semi").withColumn("a", half).withColumn("b", half).withColumn("ci", F.col("ci") * 2 + F.col("a")).withColumn("cj", F.col("cj") * 2 + F.col("b")).drop("a", "b")
        now = saved(cut.where((F.floor(F.col("s") * twice) <= F.col("ci")) & (F.floor(F.col("n") * twice) >= F.col("ci")) & (F.floor(F.col("w") * twice) <= F.col("cj")) & (F.floor(F.col("e") * twice) >= F.col("cj"))))
        if now.isEmpty():
            return out
    return out


def candidates(points: DataFrame, segments: DataFrame, tolerance: float = TOLERANCE_M, most: int = MOST_SEGMENTS) -> DataFrame:
    """(way_id, pos, t, len, dist, and `times` where the points have it) for points within the tolerance of a segment of their own coarse cell: an equi-join on cells that get finer
    where segments are dense. A point looks only at the levels that its coarse cell has."""
    cells = saved(match_cells(segments, tolerance, most))
    coarse = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    levels = cells.groupBy(coarse("ci").alias("i"), coarse("cj").alias("j")).agg(F.collect_set("level").alias("levels"))  # DEPTH + 1 at most
    own = ["lat", "lon", *(c for c in points.columns if c == "times")]
    p = points.select(*own, geo.cell(F.col("lat"), GRID).alias("i"), geo.cell(F.col("lon"), GRID).alias("j")).join(levels, ["i", "j"])
    p = p.select(*own, F.explode("levels").alias("level"))
    fine = lambda c: F.floor(F.col(c) / GRID * F.pow(F.lit(2.0), F.col("level")))
    pad = tolerance * 1.001 / geo.DEGREE_M
    p = p.select(*own, "level", fine("lat").alias("ci"), fine("lon").alias("cj"), (F.lit(pad) / F.cos(F.radians("lat"))).alias("pad"))
    lat, lon, wide = F.col("lat"), F.col("lon"), F.col("pad")
    #: Far cheaper than the distance, and no pair within the tolerance fails it.
    box = lat.between(F.least("lat1", "lat2") - pad, F.greatest("lat1", "lat2") + pad) & lon.between(F.least("lon1", "lon2") - wide, F.greatest("lon1", "lon2") + wide)
    d, t, n = geo.project_planar(*(F.col(c) for c in ("lat", "lon", *ENDS)))
    return p.join(cells, ["level", "ci", "cj"]).where(box).select("way_id", "pos", t.alias("t"), n.alias("len"), d.alias("dist"), *own[2:]).where(F.col("dist") <= tolerance)


def segment_coverage(near: DataFrame) -> DataFrame:
    rows = near.groupBy("way_id", "pos").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("len").alias("len"))
    span = F.col("t1") - F.col("t0")
    return rows.withColumn("ridden", (span * F.col("len") >= COVERED_M) | (span >= SPAN))


def ridden(points: DataFrame, segments: DataFrame) -> DataFrame:
    return segment_coverage(candidates(shared_points(legs(points)), segments)).where("ridden").select("way_id", "pos")


def ridden_runs(ridden_: DataFrame) -> DataFrame:
    """Maximal runs of consecutive ridden segments of a way."""
    island = F.col("pos") - F.row_number().over(W.partitionBy("way_id").orderBy("pos"))
    return ridden_.withColumn("island", island).groupBy("way_id", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).drop("island")


def ridden_flag(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(way_id, pos) of segments with a trace point less than 25 m away, not beside their ends; longitudes are scaled at the segment's middle.
    Padded boxes are cut into small cells, whose columns are as wide in metres on every row, so that boxes near a pole have few as well."""
    pad_lat = FLAG_M * 1.002 / geo.DEGREE_M
    row = F.col("ci")
    shrink = F.greatest(F.lit(0.0), F.cos(F.radians(row * FLAG_GRID)))
    column = lambda lon: F.floor(lon * shrink / FLAG_GRID)
    # 25 m reach farthest in longitude at the latitude nearest to the pole that a point of the row can be near to.
    top = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(row), F.abs(row + 1)) * FLAG_GRID + pad_lat)))
    wide = F.least(F.lit(360.0), pad_lat * 2 / F.greatest(top, F.lit(1e-9)))
    s = segments.select("way_id", "pos", *ENDS, F.explode(F.sequence(F.floor((F.least("lat1", "lat2") - pad_lat) / FLAG_GRID), F.floor((F.greatest("lat1", "lat2") + pad_lat) / FLAG_GRID))).alias("ci"))
    s = s.withColumn("cj", F.explode(F.sequence(column(F.least("lon1", "lon2") - wide), column(F.greatest("lon1", "lon2") + wide))))
    p = points.select("lat", "lon").distinct().withColumn("ci", geo.cell(F.col("lat"), FLAG_GRID)).withColumn("cj", column(F.col("lon")))
    t, y, x = geo.project(*(F.col(c) for c in ("lat", "lon", *ENDS)), at=(F.col("lat1") + F.col("lat2")) / 2)
    near = s.join(p, ["ci", "cj"]).select("way_id", "pos", t.alias("t"), geo.haversine_m(F.col("lat"), F.col("lon"), y, x).alias("d"))
    return near.where((F.col("d") < FLAG_M) & F.col("t").between(0.05, 0.95)).select("way_id", "pos").distinct()
