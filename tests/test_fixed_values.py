"""Values that decide results, stated here on their own, and what follows from them."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import activities, network


def test_lists():
    assert sorted(network.ROUTABLE) == sorted("trunk primary secondary tertiary unclassified residential living_street motorway_link trunk_link primary_link secondary_link tertiary_link track cycleway".split())
    assert sorted(network.MAJOR) == sorted("motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link".split())
    assert sorted(network.TRAIL) == sorted("path track footway cycleway".split())
    assert sorted(network.GRAVEL) == sorted("gravel dirt unpaved sand compacted fine_gravel earth ground woodchips grass mud".split())
    assert sorted(activities.CYCLING) == sorted("ride ebikeride gravelride mountainbikeride velomobile handcycle".split())


@pytest.mark.parametrize("sport, counts", [("Ride", True), ("ride", True), ("EBikeRide", True), ("GravelRide", True), ("MountainBikeRide", True), ("Handcycle", True), ("EMountainBikeRide", False), ("Run", False), ("VirtualRide", False), ("", False), (None, False)])
def test_cycling(spark, sport, counts):
    assert activities.biking(spark.createDataFrame([(sport, sport)], "sport_type string, type string")).count() == counts


WAYS = "highway string, surface string, construction string, construction_highway string"


def test_ways(spark):
    ways = spark.createDataFrame([("service", None, None, None), ("tertiary", "woodchips", None, "x"), ("unclassified", "pebblestone", None, None), ("track", None, "minor", None), (None, "mud", None, None), ("motorway", None, None, None)], WAYS)
    of = lambda rows: {r["highway"] for r in rows.collect()}
    assert of(network.routable(ways)) == {"tertiary", "unclassified", "track"}
    assert of(network.network_profile(ways, "overlay")) == of(network.network_profile(ways, "display")) == {"service", "tertiary", "unclassified", "track", None}
    flags = ways.select("highway", network.avoided(major=True).alias("major"), network.avoided(gravel=True).alias("gravel"), network.under_construction(*(F.col(c) for c in ("construction", "construction_highway", "highway"))).alias("works"))
    assert {tuple(r) for r in flags.collect()} == {("service", False, False, False), ("tertiary", False, True, True), ("unclassified", False, False, False), ("track", False, True, True), (None, False, True, False), ("motorway", True, False, False)}
