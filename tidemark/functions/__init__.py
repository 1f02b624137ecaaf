"""Scalar expressions: longitudes, decimal years, distances on the sphere, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean radius of the Earth and the lengths of a degree, in km.
EARTH_KM = 6371.0088
LAT_KM, LON_KM = 110.574, 111.320


def lon_to_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0)) + 0.0  # no negative zero


def lon_to_180(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def decimal_year(time: Column) -> Column:
    """Year plus month / 12, so December is the next year's start."""
    return F.year(time) + F.month(time) / 12.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def not_nan(value: Column) -> Column:
    """NULL for NaN: Spark holds NaN for larger than any number, so it must not reach a predicate."""
    return F.when(~F.isnan(value), value)


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi area / perimeter squared; NULL where the perimeter is 0."""
    return F.try_divide(4 * F.pi() * area, perimeter * perimeter)


def percentile_key(q: float) -> str:
    """The name of a quantile's column: the percentage is cut, not rounded."""
    return f"percentile_{int(q * 100)}"
