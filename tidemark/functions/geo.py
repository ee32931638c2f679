"""Distances and boxes on the sphere, as Column expressions that keep nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in nautical miles.
RADIUS_NM = 3440.065


def distance_nm(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance in nautical miles; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), F.lit(2.0)) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(F.radians(lon - lon0) / 2), F.lit(2.0))
    held = F.when(a > 1, F.lit(1.0)).when(a < 0, F.lit(0.0)).otherwise(a)
    return F.when(lat.isNotNull() & lon.isNotNull(), 2 * RADIUS_NM * F.asin(F.sqrt(held)))


def within_nm(lat: Column, lon: Column, lat0: float, lon0: float, nm: float) -> Column:
    """Whether a place lies within nm of a point, the edge included; a latitude envelope lets scans skip row groups."""
    if not (0 <= nm < float("inf") and -90 <= lat0 <= 90 and -180 <= lon0 <= 180):
        raise ValueError("a radius must be finite and not negative, a centre a place on earth")
    reach = nm / 60 * 1.01 + 1e-6
    return (lat >= lat0 - reach) & (lat <= lat0 + reach) & (F.round(distance_nm(lat, lon, lat0, lon0), 9) <= nm)


def in_bbox(lat: Column, lon: Column, lat_min: float, lon_min: float, lat_max: float, lon_max: float) -> Column:
    """Whether a place lies in the box, edges included; it wraps where lon_min > lon_max, and 180 and -180 are one meridian."""
    if lat_min > lat_max:
        raise ValueError("latitudes are reversed")
    if lon_min <= lon_max:
        across = (lon >= lon_min) & (lon <= lon_max)
        if lon_min == -180 or lon_max == 180:
            across = across | (F.abs(lon) == 180)
    else:
        across = (lon >= lon_min) | (lon <= lon_max)
    return (lat >= lat_min) & (lat <= lat_max) & across
