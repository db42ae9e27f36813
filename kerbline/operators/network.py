"""Street network: ways to segments with costs and flags, profiles, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import geo

#: The classes that decide results.
ROUTABLE = "trunk primary secondary tertiary unclassified residential living_street motorway_link trunk_link primary_link secondary_link tertiary_link track cycleway".split()
MAJOR, TRAIL = "motorway trunk primary secondary motorway_link trunk_link primary_link secondary_link".split(), "path track footway cycleway".split()
GRAVEL = "gravel dirt unpaved sand compacted fine_gravel earth ground woodchips grass mud".split()
RAMPS = ["trunk_link", "motorway_link"]


def routable(ways: DataFrame) -> DataFrame:
    return ways.where(F.col("highway").isin(ROUTABLE))


def open_access(ways: DataFrame) -> DataFrame:
    return ways.where(~F.coalesce("access", F.lit("")).isin("private", "no"))


def network_profile(ways: DataFrame, profile: str) -> DataFrame:
    """`overlay` drops motorways; `display` drops motorways, trunks and their links. Both keep ways without a class."""
    dropped = ["motorway"] if profile == "overlay" else ["motorway", "trunk", "motorway_link", "trunk_link"]
    return ways.where(~F.coalesce("highway", F.lit("")).isin(dropped))


def avoided(major: bool = False, trails: bool = False, gravel: bool = False) -> Column:
    h, s = F.col("highway"), F.col("surface")
    out = h.isin("trunk", *RAMPS)
    if major:
        out = out | h.isin(MAJOR)
    if trails:
        out = out | h.isin(TRAIL)
    if gravel:
        out = out | F.coalesce(s.isin(GRAVEL), F.lit(False)) | (s.isNull() & (h == "track"))
    return F.coalesce(out, F.lit(False))


def weight(length: Column, highway: Column, is_avoided: Column, avoid_highways: bool = True) -> Column:
    trunk, ramp = (12.0, 30.0) if avoid_highways else (2.0, 5.0)
    return length * F.when(highway == "trunk", trunk).when(highway.isin(RAMPS), ramp).when(is_avoided, 50.0).otherwise(1.0)


def under_construction(construction: Column, construction_highway: Column, highway: Column) -> Column:
    """Whether a way has either construction tag, whatever it says, or is of that class."""
    return construction.isNotNull() | construction_highway.isNotNull() | F.coalesce(highway == "construction", F.lit(False))


def pairs(way_nodes: DataFrame) -> DataFrame:
    """(way_id, pos, u, v) for consecutive nodes of each way."""
    w = W.partitionBy("way_id").orderBy("pos")
    return way_nodes.select("way_id", "pos", F.col("node_id").alias("u"), F.lead("node_id").over(w).alias("v")).where("v is not null")


def with_coordinates(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node lookup for both ends; a segment with an unknown end is dropped."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return segments.join(a, "u").join(b, "v")


def build_segments(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each physical segment of the routable, open network."""
    kept = open_access(routable(ways))
    located = with_coordinates(pairs(way_nodes).join(kept, "way_id"), nodes)
    length = geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return (
        located.withColumn("length_m", length)
        .withColumn("is_avoided", avoided())
        .withColumn("weight", weight(F.col("length_m"), F.col("highway"), F.col("is_avoided")))
        .withColumn("has_construction", under_construction(F.col("construction"), F.col("construction_highway"), F.col("highway")))
    )


def adjacency(segments: DataFrame) -> DataFrame:
    """Both directions of every segment."""
    there = segments.select("way_id", "pos", "u", "v", "weight")
    return there.union(segments.select("way_id", "pos", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def polylines(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, line): ordered coordinates of ways with two known vertices or more."""
    rows = way_nodes.join(nodes, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("line"))
    return rows.where(F.size("line") >= 2)


def node_degree(required: DataFrame) -> DataFrame:
    return required.select("area_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("area_id", "node_id").agg(F.count("*").alias("degree"))
