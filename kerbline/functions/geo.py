"""Column functions over degrees, metres and cells; built-ins only, so all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that define results.
EARTH_M, EARTH_TURF_M, DEGREE_M = 6371000.0, 6371008.8, 111320.0
CELL_M, MILE_M, FOOT = 15.0, 1609.344, 3.28084
CELL = CELL_M * (1.0 / DEGREE_M)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding half up towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2.0 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1.0 - a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def project(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, at: Column | None = None) -> tuple[Column, Column, Column]:
    """t along the segment (0 to 1), and the closest point's latitude and longitude; longitudes scaled at latitude `at`, else at the first end."""
    k = F.cos(F.radians(lat1 if at is None else at))
    dx, dy, px, py = (lon2 - lon1) * k, lat2 - lat1, (lon - lon1) * k, lat - lat1
    t = F.coalesce((px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t, lat1 + (lat2 - lat1) * t, lon1 + (lon2 - lon1) * t


def project_planar(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column]:
    """Metres to the segment, t, and the segment's metres on a plane tangent at the point."""
    kx = F.cos(F.radians(lat)) * DEGREE_M
    dx, dy, px, py = (lon2 - lon1) * kx, (lat2 - lat1) * DEGREE_M, (lon - lon1) * kx, (lat - lat1) * DEGREE_M
    t = F.coalesce((px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)), t, F.sqrt(dx * dx + dy * dy)


def cell(x: Column, size: float = CELL) -> Column:
    return F.floor(x / size)


def cell_center(k: Column, size: float = CELL) -> Column:
    return (k + 0.5) * size


def place_bucket(x: Column) -> Column:
    """Number of the 0.05 degree bucket, half up."""
    return F.floor(x * 20.0 + 0.5)


def semicircles(deg: Column) -> Column:
    return F.floor(deg * (2147483648.0 / 180.0) + 0.5)


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
