"""Distances on the ellipsoid and the plane, and cells that make a radius join an equi-join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84: equatorial radius in metres, flattening.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
#: Metres in a degree of latitude, at least.
DEGREE = 110574.0


def geo_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on WGS84, by Lambert's formula for long lines (error of some 10 m in thousands of km)."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    half = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2) / F.pow(F.sin(s / 2), 2)
    return F.when(half <= 0, F.lit(0.0)).otherwise(RADIUS * (s - FLATTENING / 2 * (x + y)))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of the mean radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in degrees, as on a plane."""
    return F.sqrt(F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2))


def cell(lon: Column, lat: Column, radius_m: float) -> tuple[Column, Column]:
    """A cell (row, column) at least ``radius_m`` high and, within its row of cells, as wide: points within the radius are in
    the same or neighbouring rows, and in a row at most ``columns_within`` columns away."""
    row = F.floor((lat + 90) * DEGREE / radius_m)
    return row, F.floor((lon + 180) * DEGREE / radius_m)


def columns_within(lat: Column) -> Column:
    """Columns that a radius spans at most at a latitude; columns get narrower towards the poles."""
    return F.least(F.ceil(1.2 / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + 1, F.lit(89.9)))), F.lit(1e-3))), F.lit(1000)).cast("int")
