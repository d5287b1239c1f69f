"""Distances, headings and the Lambert grid as Column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline import params as P


def pmod360(x: Column) -> Column:
    """Angle in [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (F.sin(half_dlat) * F.sin(half_dlat)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon))
    return F.lit(2 * P.EARTH_RADIUS_M) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with 111 km per degree, longitude scaled at the first point."""
    dy = (lat2 - lat1) * 111_000.0
    dx = (lon2 - lon1) * 111_000.0 * F.cos(F.radians(lat1))
    return F.sqrt(dy * dy + dx * dx)


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Euclidean distance in degrees; times 110000 (or 111000) it is the rough metric distance."""
    dy, dx = lat2 - lat1, lon2 - lon1
    return F.sqrt(dy * dy + dx * dx)


def distance_from_base_km(lat: Column, lon: Column) -> Column:
    return degrees_apart(F.lit(P.BASE_LAT), F.lit(P.BASE_LON), lat, lon) * 110.0


def heading_from_base(lat: Column, lon: Column) -> Column:
    """Compass heading of the straight flight from the base, in planar degrees."""
    return pmod360(F.degrees(F.atan2(lon - P.BASE_LON, lat - P.BASE_LAT)))


def _lcc_constants() -> tuple[float, float, float]:
    g = P.LCC
    a, b = math.radians(g["lat1"]), math.radians(g["lat2"])

    def t(phi):
        return math.tan(math.pi / 4 + phi / 2)

    cone = math.log(math.cos(a) / math.cos(b)) / math.log(t(b) / t(a))
    scale = g["radius_km"] / g["grid_km"] * t(a) ** cone * math.cos(a) / cone
    return cone, scale, scale / t(math.radians(g["lat0"])) ** cone


LCC_CONE, LCC_SCALE, LCC_ORIGIN = _lcc_constants()


def lcc_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(nx, ny) of the 5 km forecast grid; the half is added before truncation."""
    r = F.lit(LCC_SCALE) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(LCC_CONE))
    dlon = F.radians(lon) - math.radians(P.LCC["lon0"])
    wrapped = (F.when(dlon > math.pi, dlon - 2 * math.pi)
               .when(dlon < -math.pi, dlon + 2 * math.pi).otherwise(dlon)) * LCC_CONE
    nx = (r * F.sin(wrapped) + P.LCC["x0"] + 0.5).cast("int")
    ny = (F.lit(LCC_ORIGIN) - r * F.cos(wrapped) + P.LCC["y0"] + 0.5).cast("int")
    return nx, ny


def lcc_inverse(nx: Column, ny: Column) -> tuple[Column, Column]:
    """Grid coordinates back to (lat, lon); the pole has no direction."""
    x = nx.cast("double") - P.LCC["x0"]
    y = F.lit(LCC_ORIGIN + P.LCC["y0"]) - ny.cast("double")
    r = F.sqrt(x * x + y * y)
    safe = F.when(r > 0, r)
    lat = F.degrees(2 * F.atan(F.pow(F.lit(LCC_SCALE) / safe, F.lit(1 / LCC_CONE))) - math.pi / 2)
    lon = F.degrees(F.atan2(x, y) / LCC_CONE) + P.LCC["lon0"]
    pole = r == 0
    return F.when(pole, 90.0).otherwise(lat), F.when(pole, P.LCC["lon0"]).otherwise(lon)
