"""Rides: cleaning, totals, records, readings from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import geo

#: What counts as cycling, and the plausible range of watts.
CYCLING = "ride ebikeride gravelride mountainbikeride handcycle velomobile".split()
WATTS = (50, 600)
MIN_DIAGONAL_M = 250


def biking(activities: DataFrame) -> DataFrame:
    return activities.where(F.lower(F.coalesce(F.nullif("sport_type", F.lit("")), "type")).isin(CYCLING))


def extents(points: DataFrame) -> DataFrame:
    box = points.groupBy("activity_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), F.count("*").alias("n"))
    return box.withColumn("diagonal_m", geo.haversine_m(F.col("south"), F.col("west"), F.col("north"), F.col("east")))


def moving(activities: DataFrame, points: DataFrame) -> DataFrame:
    """Activities of two points or more whose box has a diagonal of 250 m or more."""
    return activities.join(extents(points).where((F.col("n") >= 2) & (F.col("diagonal_m") >= MIN_DIAGONAL_M)).select("activity_id"), "activity_id", "left_semi")


def ride_day(date: Column) -> Column:
    return F.nullif(F.substring(date, 1, 10), F.lit(""))


def ride_year(date: Column) -> Column:
    return F.nullif(F.try_to_number(F.substring(date, 1, 4), F.lit("9999")).cast("int"), F.lit(0))


def records(rides: DataFrame) -> DataFrame:
    return rides.groupBy("athlete_id").agg(
        (F.sum("distance_m") / geo.MILE_M).alias("total_mi"),
        (F.max("distance_m") / geo.MILE_M).alias("longest_mi"),
        (F.max("gain_m") * geo.FOOT).alias("biggest_climb_ft"),
        F.countDistinct(ride_day(F.col("start_date"))).alias("active_days"),
    )


def tokens(comments: DataFrame) -> DataFrame:
    """Tiles of the text with their starts: mentions of ftp, numbers of 2 or 3 digits, single characters."""
    tiles = comments.select("event_id", "athlete_id", "ts", F.posexplode(F.regexp_extract_all("text", F.lit(r"((?i:ftp)|\d{2,3}|(?s:.))"), F.lit(1))).alias("i", "tok"))
    w = W.partitionBy("event_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return tiles.withColumn("at", F.sum(F.length("tok")).over(w) - F.length("tok")).where("lower(tok) = 'ftp' or length(tok) > 1")


def ftp_readings(comments: DataFrame, named: bool = False) -> DataFrame:
    """(event_id, ftp): the plausible number nearest a mention; with `named`, the first plausible one where there is no mention."""
    tok = tokens(comments)
    numbers = tok.where("lower(tok) <> 'ftp'").select("event_id", F.col("tok").cast("int").alias("watts"), F.col("at").alias("p")).where(F.col("watts").between(*WATTS))
    anchors = tok.where("lower(tok) = 'ftp'").select("event_id", F.col("at").alias("q"))
    near = numbers.join(anchors, "event_id").groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("p") - F.col("q")).alias("d"), "p", "watts")).alias("best"))
    out = comments.select("event_id", "athlete_id", "ts").join(near.select("event_id", F.col("best.watts").alias("a")), "event_id", "left")
    if not named:
        return out.select("event_id", "athlete_id", "ts", F.col("a").alias("ftp"))
    first = numbers.join(anchors, "event_id", "left_anti").groupBy("event_id").agg(F.min_by("watts", "p").alias("b"))
    return out.join(first, "event_id", "left").select("event_id", "athlete_id", "ts", F.coalesce("a", "b").alias("ftp"))


def latest(readings: DataFrame) -> DataFrame:
    """Each athlete's last reading, and its change from the one before."""
    w = W.partitionBy("athlete_id").orderBy("ts", "event_id")
    rows = readings.where("ftp is not null").select("athlete_id", "ts", "event_id", "ftp", (F.col("ftp") - F.lag("ftp").over(w)).alias("change"))
    return rows.groupBy("athlete_id").agg(F.max(F.struct("ts", "event_id", "ftp", "change")).alias("x")).select("athlete_id", "x.ftp", "x.change")
