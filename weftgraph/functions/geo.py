"""Distances and boxes on a sphere, as column expressions.

Points are structs (lat, lon) in degrees.  A null point gives a null distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres (fixed value).
RADIUS = 6_371_008.8


def _wrapped(degrees: Column) -> Column:
    """A difference of longitudes in [-180, 180)."""
    return F.pmod(degrees + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def _cosine(lat: Column) -> Column:
    return F.when(F.abs(lat) == 90.0, F.lit(0.0)).otherwise(F.cos(F.radians(lat)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places."""
    up = F.sin(F.radians(lat2 - lat1) / 2)
    along = F.sin(F.radians(_wrapped(lon2 - lon1)) / 2)
    h = up * up + _cosine(lat1) * _cosine(lat2) * along * along
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def distance(point: Column, lat: float, lon: float) -> Column:
    return haversine(point["lat"], point["lon"], F.lit(float(lat)), F.lit(float(lon)))


def in_box(point: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; west > east crosses the antimeridian."""
    lat, lon = point["lat"], point["lon"]
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def circle_box(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """A box (south, west, north, east) that holds the whole circle."""
    angle = math.degrees(metres / RADIUS) * (1 + 1e-9) + 1e-9
    south, north = max(-90.0, lat - angle), min(90.0, lat + angle)
    if south <= -90 or north >= 90 or angle >= 90:
        return south, -180.0, north, 180.0
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(angle)) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
    if wide >= 180:
        return south, -180.0, north, 180.0
    west, east = lon - wide, lon + wide
    return south, west + 360 if west < -180 else west, north, east - 360 if east > 180 else east


def within(point: Column, lat: float, lon: float, metres: float, strict: bool) -> Column:
    """Within a radius; the box goes first, so that Parquet statistics can prune."""
    d = distance(point, lat, lon)
    return in_box(point, *circle_box(lat, lon, metres)) & ((d < metres) if strict else (d <= metres))


def cube(lat: Column, lon: Column, metres: float) -> Column:
    """Cell (x, y, z) of a cubic grid through the sphere with edges of ``metres``.

    A chord is no longer than its arc, so places within ``metres`` of each
    other differ by at most one cell along each axis; poles and the
    antimeridian need no special care.
    """
    edge = max(metres, 1e-3) * (1 + 1e-9)
    a, b = F.radians(lat), F.radians(lon)
    axes = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
    return F.struct(*[F.floor(x * F.lit(RADIUS / edge)).cast("long").alias(n) for x, n in zip(axes, "xyz")])


def around(cell: Column) -> Column:
    """The 27 cells at and beside a cell."""
    beside = F.array(*[F.lit(d) for d in (-1, 0, 1)])

    def moved(x):
        return F.transform(beside, lambda y: F.transform(beside, lambda z: F.struct((cell.x + x).alias("x"), (cell.y + y).alias("y"), (cell.z + z).alias("z"))))

    return F.flatten(F.flatten(F.transform(beside, moved)))
