"""Street network, rides, places and areas derived from the given tables by integer arithmetic."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Classes by way number.
HIGHWAYS = ["residential", "residential", "tertiary", "secondary", "primary", "trunk", "cycleway", "track", "trunk_link", "motorway"]
SURFACES = ["asphalt", "paved", "gravel", "dirt"]
SPORTS = ["Ride", "EBikeRide", "GravelRide", "VirtualRide", "Run", "MountainBikeRide"]


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


class Domain:
    """The domain's tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        i, j = F.floor(F.col("p_partkey") / 20), F.col("p_partkey") % 20
        return self.table("part").select(
            F.col("p_partkey").alias("node_id"), ((47600000 + 1000 * i) / 1e6).alias("lat"), ((-117400000 + 1000 * j) / 1e6).alias("lon")
        )

    @cached_property
    def way_nodes(self) -> DataFrame:
        i, j, key = F.floor(F.col("p_partkey") / 20), F.col("p_partkey") % 20, F.col("p_partkey").alias("node_id")
        part = self.table("part")
        return part.select(i.alias("way_id"), j.alias("pos"), key).union(part.select(1000000 + j, i, key))

    @cached_property
    def ways(self) -> DataFrame:
        w = F.col("way_id")
        return self.way_nodes.select("way_id").distinct().select(
            "way_id",
            F.when(w % 29 == 7, "service").when(w % 23 != 5, pick(HIGHWAYS, w % 10)).alias("highway"),
            F.when(w % 19 == 3, "woodchips").when(w % 31 != 7, pick(SURFACES, w % 4)).alias("surface"),
            F.when(w % 11 == 0, "minor").alias("construction"),
            F.when(w % 13 == 4, "residential").alias("construction_highway"),
            F.when(w % 17 == 0, "private").alias("access"),
        )

    @cached_property
    def points(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        half = lambda k: F.floor(e * k / 2) % 3 - 1
        week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
        rows = self.table("events").select(
            (u * 100 + week).alias("activity_id"), u.alias("athlete_id"), "ts", "event_id", "value",
            F.when(e % 2 == 0, half(7)).otherwise(0).alias("di"), F.when(e % 2 == 1, half(5)).otherwise(0).alias("dj"),
        )
        w = W.partitionBy("activity_id").orderBy("ts", "event_id")
        run = w.rowsBetween(W.unboundedPreceding, 0)
        return rows.select(
            "activity_id", "athlete_id", "ts", "event_id", "value", F.row_number().over(w).cast("bigint").alias("seq"),
            ((47600000 + 1000 * (u_mod("athlete_id", 10) + F.sum("di").over(run)) + ((e * 31) % 13 - 6) * 10) / 1e6).alias("lat"),
            ((-117400000 + 1000 * (u_mod("athlete_id", 20) + F.sum("dj").over(run)) + ((e * 17) % 13 - 6) * 10) / 1e6).alias("lon"),
            F.when(e % 9 > 0, e % 400).cast("double").alias("ele"), (e % 7 == 0).alias("construction"),
        )

    @cached_property
    def activities(self) -> DataFrame:
        a = F.col("activity_id")
        return self.points.groupBy("activity_id", "athlete_id").agg(
            F.floor(F.sum(F.floor(F.col("value") * 100 + 0.5)) / 10).cast("double").alias("distance_m"),
            F.sum(F.floor(F.col("value") + 0.5)).cast("double").alias("gain_m"),
            F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_date"),
        ).withColumn("sport_type", F.when(a % 13 == 0, "").when(a % 31 == 4, "Handcycle").when(a % 31 == 9, "EMountainBikeRide").otherwise(pick(SPORTS, a % 6))).withColumn("type", F.when(a % 13 == 0, pick(SPORTS, a % 5)).otherwise("Workout"))

    @cached_property
    def boxes(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.alias("area_id"), ((47600000 + 1000 * (s % 90)) / 1e6).alias("south"), ((-117400000 + 1000 * (s % 14)) / 1e6).alias("west"),
            ((47600000 + 1000 * (s % 90 + 5)) / 1e6).alias("north"), ((-117400000 + 1000 * (s % 14 + 5)) / 1e6).alias("east"),
        )

    @cached_property
    def rings(self) -> DataFrame:
        """A notched five-cornered ring for each supplier, as ordered corners."""
        s = F.col("s_suppkey")
        corner = lambda di, dj: F.struct(((47600500 + 1000 * (s % 90 + di)) / 1e6).alias("lat"), ((-117400500 + 1000 * (s % 14 + dj)) / 1e6).alias("lon"))
        ring = F.array(corner(0, 0), corner(0, 6), corner(6, 6), corner(3, 3), corner(6, 0))
        return self.table("supplier").select(s.alias("polygon_id"), ring.alias("ring"))

    @cached_property
    def places(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select(
            F.col("n_nationkey").cast("bigint").alias("place_key"), F.concat(F.lit("City "), (F.col("n_nationkey") % 9).cast("string")).alias("city"),
            F.concat(F.lit("County "), (F.col("n_nationkey") % 6).cast("string")).alias("county"), F.col("n_name").alias("state"), F.col("r_name").alias("country"),
        )

    @cached_property
    def buckets(self) -> DataFrame:
        """A place for each 5 km bucket of the network and three around it."""
        at = lambda c: F.floor(F.col(c) * 20 + 0.5)
        span = self.nodes.agg(*(f(at(c)).alias(f"{n}_{c}") for f, n in ((F.min, "lo"), (F.max, "hi")) for c in ("lat", "lon")))  # one row
        every = lambda c: F.explode(F.sequence(F.col(f"lo_{c}") - 3, F.col(f"hi_{c}") + 3))
        grid = span.withColumn("bucket_lat", every("lat")).withColumn("bucket_lon", every("lon")).select("bucket_lat", "bucket_lon")
        key = F.pmod(F.col("bucket_lat") * 7 + F.col("bucket_lon") * 3, F.lit(25))
        return grid.withColumn("place_key", key).join(self.places, "place_key")

    @cached_property
    def comments(self) -> DataFrame:
        k, e = F.get_json_object("props", "$.k"), F.col("event_id")
        text = (
            F.when(e % 4 == 0, F.concat(F.lit("my FTP is "), k, F.lit("0 today, felt like "), k))
            .when(e % 4 == 1, F.concat(k, F.lit("4W for the 20 min test which is "), k, F.lit("2W ftp")))
            .when(e % 4 == 2, F.concat(F.lit("rode "), k, F.lit(" miles at 200 watts")))
            .otherwise(F.concat(F.lit("Ftp? "), k, F.lit("1 or 2"), k))
        )
        return self.table("events").select("event_id", F.col("user_id").alias("athlete_id"), "ts", text.alias("text"))


def u_mod(name: str, k: int) -> Column:
    return F.col(name) % k
