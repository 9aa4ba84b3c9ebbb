"""Distances and places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def nearest(point: Column, places: list[tuple[str, float]]) -> Column:
    """struct(distance, name) of the place nearest to ``point`` on a line; ``places`` is a short literal list."""
    options = F.array(*[F.struct(F.abs(point - F.lit(x)).alias("distance"), F.lit(n).alias("name")) for n, x in places])
    return F.array_min(options)
