"""City coverage where polygons, ways and legs are many and alike."""

from pyspark.sql import functions as F

from kerbline.operators import areas, coverage
from kerbline.plans import catalog, elements
from kerbline.sources.domain import Domain

SF = "/root/testdata/sf0.001"


def test_equal_polygons_and_legs_are_answered_once(spark, monkeypatch):
    d = Domain(spark, SF)
    plain = {r["polygon_id"]: tuple(r)[1:] for r in elements.city_coverage(d).collect()}
    assert any(r[1] > 0 for r in plain.values())
    many = Domain(spark, SF)
    copy = F.explode(F.sequence(F.lit(0), F.lit(4)))
    own = d.rings.withColumn("copy", copy).select((F.col("polygon_id") + F.col("copy") * 1000).alias("polygon_id"), "ring")
    lost = spark.range(1).select(F.lit(-1).cast("bigint").alias("polygon_id"), F.lit(None).cast(own.schema["ring"].dataType).alias("ring"))
    many.rings = own.union(lost)
    twice = F.explode(F.array(F.lit(0), F.lit(13 * 31 * 6 * 5)))  # a ride's sport follows from its number
    many.points = d.points.withColumn("again", twice).withColumn("activity_id", F.col("activity_id") + F.col("again")).drop("again")
    rings, legs = [], []
    in_polygons, cells = areas.points_in_polygons, coverage.cells
    monkeypatch.setattr(areas, "points_in_polygons", lambda p, r, *more: (rings.append(r.count()), in_polygons(p, r, *more))[1])
    monkeypatch.setattr(coverage, "cells", lambda x: (legs.append(x.count()), cells(x))[1])
    got = {r["polygon_id"]: tuple(r)[1:] for r in elements.city_coverage(many).collect()}
    assert got.pop(-1) == (0, 0.0, 0.0, 0.0)
    assert got == {i + 1000 * k: (a * 2, *rest) for i, (a, *rest) in plain.items() for k in range(5)}
    distinct = d.rings.select("ring").distinct().count()
    assert set(rings) <= {distinct, distinct + 1}
    ways, rides = legs
    assert ways < catalog.network.pairs(d.way_nodes).count()  # some way is in no polygon
    assert rides <= catalog.legs(d).count()
