"""Every SQL function gives what the column function of its name gives."""

from pyspark.sql import functions as F

from kerbline.functions import geo, sql
from kerbline.operators import activities


def test_sql_functions(spark):
    sql.register(spark)
    rows = [(47.6, -117.4, 47.61, -117.39, 47.604, -117.395, "2024-02-03T04:05:06Z", "a & <b> \"c\" 'd'"), (0.0, 10.0, 0.0, 10.0, -3.0, 9.0, "", ""), (-40.5, 179.0, 12.0, -179.0, 1.0, 2.0, None, None), (45.0, -100.0, 45.0, -99.0, 45.0, -99.25, "0000-01-01", "x")]
    df = spark.createDataFrame(rows, "lat1 double, lon1 double, lat2 double, lon2 double, lat double, lon double, s string, t string")
    df.createOrReplaceTempView("sql_function_rows")
    c = {n: F.col(n) for n in df.columns}
    ends = [c[n] for n in ("lat1", "lon1", "lat2", "lon2")]
    want = {
        "haversine_m(lat1, lon1, lat2, lon2)": geo.haversine_m(*ends),
        "bearing_deg(lat1, lon1, lat2, lon2)": geo.bearing_deg(*ends),
        "angle_diff(abs(lon1), abs(lon2))": geo.angle_diff(F.abs("lon1"), F.abs("lon2")),
        "project_t(lat, lon, lat1, lon1, lat2, lon2)": geo.project(c["lat"], c["lon"], *ends)[0],
        "half_up(lon)": geo.half_up(c["lon"]).cast("bigint"),
        "cell_key(lat1, 0.005d)": geo.cell(c["lat1"], 0.005),
        "cell_center(7, 0.5d)": geo.cell_center(F.lit(7), 0.5),
        "place_bucket(lon1)": geo.place_bucket(c["lon1"]),
        "semicircles(lat1)": geo.semicircles(c["lat1"]),
        "metres_to_miles(lat1)": c["lat1"] / geo.MILE_M,
        "metres_to_feet(lat1)": c["lat1"] * geo.FOOT,
        "xml_escape(t)": geo.xml_escape(c["t"]),
        "ride_day(s)": activities.ride_day(c["s"]),
        "ride_year(s)": activities.ride_year(c["s"]),
        "age_days(try_to_timestamp(s), timestamp'2024-03-01 00:00:00')": F.floor((F.unix_timestamp(F.lit("2024-03-01 00:00:00")) - F.unix_timestamp(F.try_to_timestamp("s"))) / 86400),
    }
    assert {w.split("(")[0] for w in want} == set(sql.FUNCTIONS)
    got = spark.sql("SELECT " + ", ".join(want) + " FROM sql_function_rows ORDER BY lat1, lat2")
    other = df.orderBy("lat1", "lat2").select(*want.values())
    show = lambda r: [round(x, 9) if isinstance(x, float) else x for x in r]
    assert [show(r) for r in got.collect()] == [show(r) for r in other.collect()]
