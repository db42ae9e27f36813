"""Element documents: nodes, ways and relations with tags and, for some ways, coordinates of their own, as JSON or XML dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ELEMENT = "type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>"
#: Tags that decide what a way is, by column.
TAGS = {"highway": "highway", "surface": "surface", "construction": "construction", "construction_highway": "construction:highway", "access": "access"}


def read_json(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Elements (tile, type, id, lat, lon, nodes, geometry, tags) of the documents below `path`, and the documents that are none (value).

    A document is a line {"tile": number, "elements": [...]}, or with `whole` a file. Unknown fields are passed over.
    """
    lines = spark.read.text(path, wholetext=whole).where("trim(value) <> ''")
    docs = lines.select("value", F.from_json("value", f"tile bigint, elements array<struct<{ELEMENT}>>, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("d"))
    broken = F.col("d").isNull() | F.col("d.bad").isNotNull() | F.col("d.elements").isNull()
    return docs.where(~broken).select("d.tile", F.explode("d.elements").alias("e")).select("tile", "e.*"), docs.where(broken).select("value")


def merged(elements: DataFrame) -> DataFrame:
    """One element for each type and id, that of the first tile (ties by the smaller text of the element)."""
    body = F.struct(*(c for c in elements.columns if c not in ("type", "id")))
    first = elements.groupBy("type", "id").agg(F.min_by(body, F.struct("tile", F.to_json(body))).alias("x"))
    return first.select("type", "id", "x.*")


def nodes_of(elements: DataFrame) -> DataFrame:
    """node_id, lat, lon, tags of the nodes that have a place."""
    return elements.where("type = 'node' and lat is not null and lon is not null").select(F.col("id").alias("node_id"), "lat", "lon", "tags")


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def ways_of(elements: DataFrame) -> DataFrame:
    """way_id, nodes, geometry, tags, and a column for each tag that decides what a way is."""
    rows = elements.where("type = 'way' and nodes is not null")
    return rows.select(F.col("id").alias("way_id"), "nodes", "geometry", "tags", *(tag(k).alias(c) for c, k in TAGS.items()))


def vertices_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, pos, node_id, lat, lon of every node of every way: its own coordinates, else those of the node, else null."""
    rows = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"), F.col("geometry").alias("g"))
    rows = rows.select("way_id", F.col("pos").cast("bigint").alias("pos"), "node_id", F.get("g", F.col("pos")).alias("at"))
    known = nodes.select("node_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    placed = F.col("at.lat").isNotNull() & F.col("at.lon").isNotNull()
    return rows.join(known, "node_id", "left").select("way_id", "pos", "node_id", F.when(placed, F.col("at.lat")).otherwise(F.col("y")).alias("lat"), F.when(placed, F.col("at.lon")).otherwise(F.col("x")).alias("lon"))


def segments_of(vertices: DataFrame) -> DataFrame:
    """way_id, pos, u, v, lat1, lon1, lat2, lon2 for consecutive nodes that both have a place."""
    w = W.partitionBy("way_id").orderBy("pos")
    rows = vertices.select("way_id", "pos", F.col("node_id").alias("u"), F.lead("node_id").over(w).alias("v"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return rows.where("v is not null and lat1 is not null and lat2 is not null")


def polylines_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, line: coordinates in order, of the way itself where it has any, else of its nodes that have a place; two vertices at least."""
    own = ways.where("geometry is not null").select("way_id", F.filter("geometry", lambda g: g["lat"].isNotNull() & g["lon"].isNotNull()).alias("line"))
    rest = ways.where("geometry is null").select("way_id", F.posexplode("nodes").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    lines = rest.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("line"))
    return own.union(lines).where(F.size("line") >= 2)


def addresses(rows: DataFrame, column: str = "json") -> DataFrame:
    """The rows with city, county, state and country of their address documents; of several names for a level the first that is not empty."""
    address = F.from_json(column, "address map<string,string>")["address"]
    of = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at("address_", F.lit(key)), F.lit("")) for key in keys))
    out = rows.withColumn("address_", address)
    return out.select(*rows.columns, of("city", "town", "village", "hamlet", "municipality").alias("city"), of("county", "district").alias("county"), of("state", "region").alias("state"), of("country").alias("country"))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """type, id, lat, lon, nodes, tags of the nodes and ways of XML dumps. Dumps are cut at the ends of elements, so large files split; ways of one
    node go, and what is no node or way is passed over."""
    parts = spark.read.text(path, lineSep="</way>").where(F.col("value").contains("<way "))
    way = "_id bigint, nd array<struct<_ref:bigint>>, tag array<struct<_k:string,_v:string>>"
    element = F.concat(F.regexp_extract("value", r"(?s)(<way .*)$", 1), F.lit("</way>"))
    ways = parts.select(F.from_xml(element, way).alias("x")).select("x.*").where(F.size("nd") >= 2)
    none = F.lit(None).cast("double")
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")))
    ways = ways.select(F.lit("way").alias("type"), F.col("_id").alias("id"), none.alias("lat"), none.alias("lon"), F.col("nd._ref").alias("nodes"), tags.alias("tags"))
    # Every node begins with its attributes, whether it has tags or not.
    starts = spark.read.text(path, lineSep="<node ").select(F.regexp_extract("value", r"^([^>]*)>", 1).alias("a"))
    attribute = lambda name: F.nullif(F.regexp_extract("a", rf'\b{name}="([^"]*)"', 1), F.lit(""))
    nodes = starts.select(F.lit("node").alias("type"), attribute("id").try_cast("bigint").alias("id"), attribute("lat").try_cast("double").alias("lat"), attribute("lon").try_cast("double").alias("lon"))
    nodes = nodes.where("id is not null and lat is not null and lon is not null")
    return nodes.select("*", F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags")).union(ways)
