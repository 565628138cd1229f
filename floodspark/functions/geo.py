"""Distances, cells, projections and the sun, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark.functions.status import epoch_ms

# The two Earth radii in use.
EARTH_KM, EARTH_M = 6371.0088, 6_371_000.0
# Metres of a degree of latitude, and of longitude at the equator, in planar lengths.
DEGREE_LAT_M, DEGREE_LON_M = 110_574.0, 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_KM)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_M)


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance, at the latitude half way."""
    return F.hypot((lat2 - lat1) * DEGREE_LAT_M, (lon2 - lon1) * DEGREE_LON_M * F.cos(F.radians((lat1 + lat2) / 2)))


def valid_position(lat: Column, lon: Column) -> Column:
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.coalesce(ok, F.lit(False))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def web_mercator_px(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    world = 256.0 * 2**zoom
    s = F.least(F.lit(0.9999), F.greatest(F.lit(-0.9999), F.sin(F.radians(lat))))
    return (lon + 180) / 360 * world, (0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * world


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    n = 2**zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    return clamp(x), clamp(y)


def sun_elevation_deg(t: Column, lat: Column, lon: Column) -> Column:
    """The sun's elevation by the low-precision solar position formulas (about a hundredth of a degree)."""
    d = epoch_ms(t) / 86_400_000.0 - 10957.5
    g = F.radians(357.529 + 0.98560028 * d)
    q = 280.459 + 0.98564736 * d
    ecliptic = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.00000036 * d)
    ra = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = 18.697374558 + 24.06570982441908 * d
    hour = F.radians(sidereal * 15 + lon) - ra
    p = F.radians(lat)
    return F.degrees(F.asin(F.sin(p) * F.sin(declination) + F.cos(p) * F.cos(declination) * F.cos(hour)))


def is_dark(t: Column, lat: Column, lon: Column) -> Column:
    return sun_elevation_deg(t, lat, lon) < -4
