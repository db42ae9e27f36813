"""The scalar functions under SQL names: temporary functions of a session, each a SQL expression that Spark puts in its place."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kerbline.functions import geo

_HAV = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_DY, _DX = "(lat2 - lat1)", "((lon2 - lon1) * cos(radians(lat1)))"
_T = f"greatest(0d, least(1d, coalesce(((lon - lon1) * cos(radians(lat1)) * {_DX} + (lat - lat1) * {_DY}) / nullif({_DX} * {_DX} + {_DY} * {_DY}, 0d), 0d)))"
_ENDS = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"

#: Name: (parameters, type, expression).
FUNCTIONS = {
    "haversine_m": (_ENDS, "DOUBLE", f"2 * {geo.EARTH_M}d * atan2(sqrt({_HAV}), sqrt(greatest(0d, 1 - ({_HAV}))))"),
    "bearing_deg": (_ENDS, "DOUBLE", "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360d, 360d)"),
    "angle_diff": ("a DOUBLE, b DOUBLE", "DOUBLE", "least(abs(a - b), 360 - abs(a - b))"),
    "project_t": (f"lat DOUBLE, lon DOUBLE, {_ENDS}", "DOUBLE", _T),
    "half_up": ("x DOUBLE", "BIGINT", "floor(x + 0.5d)"),
    "cell_key": ("x DOUBLE, size DOUBLE", "BIGINT", "floor(x / size)"),
    "cell_center": ("k BIGINT, size DOUBLE", "DOUBLE", "(k + 0.5d) * size"),
    "place_bucket": ("x DOUBLE", "BIGINT", "floor(x * 20 + 0.5d)"),
    "semicircles": ("deg DOUBLE", "BIGINT", "floor(deg * (2147483648d / 180d) + 0.5d)"),
    "metres_to_miles": ("m DOUBLE", "DOUBLE", f"m / {geo.MILE_M}d"),
    "metres_to_feet": ("m DOUBLE", "DOUBLE", f"m * {geo.FOOT}d"),
    "xml_escape": ("t STRING", "STRING", """replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), "'", '&apos;')"""),
    "ride_day": ("started STRING", "STRING", "nullif(substring(started, 1, 10), '')"),
    "ride_year": ("started STRING", "INT", "nullif(try_cast(substring(started, 1, 4) AS INT), 0)"),
    "age_days": ("started TIMESTAMP, as_of TIMESTAMP", "BIGINT", "floor((unix_timestamp(as_of) - unix_timestamp(started)) / 86400)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session, and return their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
