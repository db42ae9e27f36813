"""Areas: boxes, polygons, tiles, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import graph

BUFFER, BIN = 0.0001, 0.01
#: Edges of a polygon that a row of its cover holds at most, and degrees by which columns are taken wider.
MOST_EDGES, SLACK = 64, 1e-9


def in_box(lat: Column, lon: Column, pad: float = BUFFER) -> Column:
    return lat.between(F.col("south") - pad, F.col("north") + pad) & lon.between(F.col("west") - pad, F.col("east") + pad)


def _bins(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))


def select_in_boxes(segments: DataFrame, boxes: DataFrame, pad: float = BUFFER) -> DataFrame:
    """Unordered node pairs of segments with an end in a buffered box: an equi-join on bins, then the exact bounds."""
    b = boxes.withColumn("bi", F.explode(_bins(F.col("south") - pad, F.col("north") + pad))).withColumn("bj", F.explode(_bins(F.col("west") - pad, F.col("east") + pad)))
    ends = F.array_distinct(F.array(*(F.struct(geo.cell(F.col(y), BIN).alias("bi"), geo.cell(F.col(x), BIN).alias("bj")) for y, x in (("lat1", "lon1"), ("lat2", "lon2")))))
    s = segments.select("u", "v", "length_m", "lat1", "lon1", "lat2", "lon2", F.explode(ends).alias("e")).select("*", "e.bi", "e.bj").drop("e")
    hit = s.join(b, ["bi", "bj"]).where(in_box(F.col("lat1"), F.col("lon1"), pad) | in_box(F.col("lat2"), F.col("lon2"), pad))
    return hit.groupBy("area_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("length_m").alias("length_m"))


def polygon_bounds(rings: DataFrame) -> DataFrame:
    of = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    return rings.select("polygon_id", of(F.array_min, "lat").alias("south"), of(F.array_min, "lon").alias("west"), of(F.array_max, "lat").alias("north"), of(F.array_max, "lon").alias("east"))


def polygon_cover(rings: DataFrame, size: float = BIN, most: int = MOST_EDGES) -> DataFrame:
    """Cells of every polygon: polygon_id, bi, bj, chunk, chunks, mid, base, items.

    A point at (lat, lon) of the cell is inside if `base` and the items it meets add up to an odd number. Cells without an edge inside
    the polygon have no items: all their points are inside. A cell at the border has the edges that its row of cells brings into its column
    (y1, x1, y2, x2), in chunks of at most `most`; edges farther east cross its points' rays wherever their latitudes do. Those cancel in
    chains, so of them only the crossings at the row's middle are kept (in `base`), and the ends of chains (y1 alone), which tell
    how other latitudes differ. No row holds a ring, and the ring's numbers are compared as plain ray casting does.
    """
    r = rings.select("polygon_id", "ring", F.posexplode("ring").alias("i", "a"))
    at = lambda k, c: F.get("ring", F.pmod(F.col("i") + k, F.size("ring")))[c]
    corner = r.select("polygon_id", F.col("i"), at(-1, "lat").alias("y0"), at(-1, "lon").alias("x0"), F.col("a.lat").alias("y1"), F.col("a.lon").alias("x1"), at(1, "lat").alias("y2"), at(1, "lon").alias("x2"))
    bi = F.col("bi")

    def columns(y1: Column, x1: Column, y2: Column, x2: Column) -> tuple[Column, Column]:
        """First and last column that an edge has in row bi; a little wider, so that rounding loses nothing."""
        lo, hi = F.greatest(F.least(y1, y2), bi * size - SLACK), F.least(F.greatest(y1, y2), (bi + 1) * size + SLACK)
        x = lambda y: F.coalesce(x1 + (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)), x1)
        a, z = F.when(y1 == y2, F.least(x1, x2)).otherwise(F.least(x(lo), x(hi))), F.when(y1 == y2, F.greatest(x1, x2)).otherwise(F.greatest(x(lo), x(hi)))
        return F.floor((a - SLACK) / size), F.floor((z + SLACK) / size)

    names = ("y0", "x0", "y1", "x1", "y2", "x2")
    before, after = (tuple(F.col(c) for c in names[k : k + 4]) for k in (0, 2))
    rows = corner.withColumn("bi", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))))
    first, last = columns(*after)
    middle = (bi + 0.5) * size
    rows = rows.select("polygon_id", "i", "bi", *names[2:], first.alias("ja"), last.alias("jb"), ((F.col("y1") > middle) != (F.col("y2") > middle)).cast("int").alias("cross"))
    own = rows.select("polygon_id", "bi", F.explode(F.sequence("ja", "jb")).alias("bj"), "i", F.struct(*names[2:]).alias("item"), F.lit(1).alias("edge"), F.col("ja"), "cross")
    own = own.withColumn("cross", F.when(F.col("bj") == F.col("ja"), F.col("cross")).otherwise(0)).drop("ja")
    ends = corner.withColumn("bi", F.floor(F.col("y1") / size))
    ends = ends.select("polygon_id", "i", "bi", "y1", columns(*before)[0].alias("j0"), columns(*after)[0].alias("j1")).where("j0 <> j1")
    none = F.lit(None).cast("double")
    ends = ends.select("polygon_id", "bi", F.explode(F.sequence(F.least("j0", "j1"), F.greatest("j0", "j1") - 1)).alias("bj"), "i", F.struct("y1", none.alias("x1"), none.alias("y2"), none.alias("x2")).alias("item"), F.lit(0).alias("edge"), F.lit(0).alias("cross"))
    cell = ["polygon_id", "bi", "bj"]
    place = F.floor((F.row_number().over(W.partitionBy(*cell).orderBy("i", "edge")) - 1) / most)
    parts = own.unionByName(ends).withColumn("chunk", place).groupBy(*cell, "chunk").agg(F.collect_list("item").alias("items"), F.sum("cross").alias("cross"))
    row = W.partitionBy("polygon_id", "bi").orderBy(F.desc("bj"))
    cells = parts.groupBy(*cell).agg(F.sum("cross").alias("cross"), F.max("chunk").alias("last"))
    cells = cells.select(*cell, (F.col("last") + 1).alias("chunks"), (F.sum("cross").over(row) - F.col("cross")).alias("base"), F.lag("bj").over(row).alias("next"))
    border = parts.join(cells, cell).select(*cell, "chunk", "chunks", middle.alias("mid"), F.when(F.col("chunk") == 0, F.col("base")).otherwise(0).alias("base"), "items")
    inner = cells.where("base % 2 = 1 and next > bj + 1").select("polygon_id", "bi", F.explode(F.sequence(F.col("bj") + 1, F.col("next") - 1)).alias("bj"))
    empty = F.array().cast("array<struct<y1:double,x1:double,y2:double,x2:double>>")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return border.unionByName(inner.select(*cell, zero.alias("chunk"), one.alias("chunks"), middle.alias("mid"), one.alias("base"), empty.alias("items")))


def points_in_polygons(points: DataFrame, rings: DataFrame, keys: list[str], size: float = BIN, most: int = MOST_EDGES) -> DataFrame:
    """(polygon_id, keys) of the points inside polygons, as half-open ray casting to the east tells it: an equi-join on the cells of polygon_cover()."""
    cover = graph.saved(polygon_cover(rings, size, most))
    p = points.withColumn("bi", geo.cell(F.col("lat"), size)).withColumn("bj", geo.cell(F.col("lon"), size))

    def meets(e: Column) -> Column:
        x = (e["x2"] - e["x1"]) * (F.col("lat") - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        crosses = F.coalesce(((e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat"))) & (F.col("lon") < x), F.lit(False))
        return F.when(e["x1"].isNull(), (e["y1"] > F.col("lat")) != (e["y1"] > F.col("mid"))).otherwise(crosses)

    met = F.size(F.filter("items", meets)) + F.col("base")
    out = p.join(cover.where("chunks = 1"), ["bi", "bj"]).where(met % 2 == 1).select("polygon_id", *keys)
    dense = cover.where("chunks > 1")
    if dense.isEmpty():
        return out
    many = p.withColumn("row_", F.monotonically_increasing_id()).join(dense, ["bi", "bj"]).groupBy("polygon_id", "row_", *keys).agg(F.sum(met).alias("met"))
    return out.union(many.where("met % 2 = 1").select("polygon_id", *keys))


def centers(points: DataFrame) -> DataFrame:
    return points.groupBy("activity_id", "athlete_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def locate(points: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each activity's place, by the 5 km bucket of its centre (bucket_lat, bucket_lon, place columns: a row for each bucket)."""
    at = centers(points).withColumns({"bucket_lat": geo.place_bucket(F.col("lat")).cast("bigint"), "bucket_lon": geo.place_bucket(F.col("lon")).cast("bigint")})
    return at.join(buckets, ["bucket_lat", "bucket_lon"])


def union_boxes(boxes: list[DataFrame], points: list[DataFrame], pad: float = BUFFER) -> DataFrame:
    """area_id, south, west, north, east around all boxes and points (lat, lon) of an area, and a little more."""
    every = [b.select("area_id", "south", "west", "north", "east") for b in boxes]
    every += [p.select("area_id", F.col("lat").alias("south"), F.col("lon").alias("west"), F.col("lat").alias("north"), F.col("lon").alias("east")) for p in points]
    out = every[0]
    for b in every[1:]:
        out = out.unionByName(b)
    return out.groupBy("area_id").agg((F.min("south") - pad).alias("south"), (F.min("west") - pad).alias("west"), (F.max("north") + pad).alias("north"), (F.max("east") + pad).alias("east"))


def footprint(points: DataFrame, size: float = 0.02) -> DataFrame:
    """athlete_id, y, x: tiles that an athlete's points touch."""
    return points.select("athlete_id", geo.cell(F.col("lat"), size).alias("y"), geo.cell(F.col("lon"), size).alias("x")).distinct()


def fetched(tiles: DataFrame, failed: DataFrame, most: int = 5000, share: float = 0.3) -> DataFrame:
    """athlete_id, tiles, too_many, failed, incomplete: whether there are too many tiles, or more than a share of them in `failed` (y, x)."""
    rows = tiles.join(failed.select("y", "x", F.lit(1).alias("bad")), ["y", "x"], "left")
    out = rows.groupBy("athlete_id").agg(F.count("*").alias("tiles"), F.count("bad").alias("failed"))
    return out.select("athlete_id", "tiles", (F.col("tiles") > most).alias("too_many"), "failed", (F.col("failed") / F.col("tiles") > share).alias("incomplete"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order: sorted by ranges, so that no task holds them all."""
    path = graph.saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = path.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.orderBy("part")) - F.col("size"))  # a row for each partition
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) + F.col("before")
    return path.join(before, "part").withColumn(name, place.cast("bigint")).drop("part", "size", "before")
