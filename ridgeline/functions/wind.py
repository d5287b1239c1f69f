"""Wind vectors, altitude profile, walking speed and times as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.functions import geo


def u_of(wind_dir: Column) -> Column:
    return -F.sin(F.radians(wind_dir))


def v_of(wind_dir: Column) -> Column:
    return -F.cos(F.radians(wind_dir))


def direction_of(u: Column, v: Column) -> Column:
    """Direction the wind comes from, [0, 360)."""
    return geo.pmod360(F.degrees(F.atan2(-u, -v)))


def at_work_altitude(speed: Column, elevation: Column, altitude: float = P.WORK_ALTITUDE_M) -> Column:
    return speed * F.pow((elevation + altitude) / P.WIND_REF_HEIGHT, F.lit(P.WIND_PROFILE_ALPHA))


def relative_profile(speed: Column, elevation: Column, source_elevation: Column) -> Column:
    """Carry a speed from the elevation it represents to another one."""
    target = F.greatest(elevation, F.lit(0.0)) + P.WIND_REF_HEIGHT
    source = F.greatest(source_elevation, F.lit(0.0)) + P.WIND_REF_HEIGHT
    return F.greatest(speed * F.pow(target / source, F.lit(P.WIND_PROFILE_ALPHA)), F.lit(0.0))


def valid_reading(speed: Column, wind_dir: Column) -> Column:
    return (speed >= -50) & (wind_dir >= -50) & (speed <= 100) & (wind_dir <= 360)


def walking_kmh(slope: Column, floor: float = 0.1) -> Column:
    """Hiking speed by slope, never below ``floor``."""
    return F.greatest(6.0 * F.exp(-3.5 * F.abs(F.tan(F.radians(slope)) + 0.05)), F.lit(floor))


def flight_minutes(metres: Column, cruise_ms: float = P.CRUISE_SPEED_MS) -> Column:
    return F.coalesce(metres, F.lit(0.0)) / cruise_ms / 60.0 if cruise_ms > 0 else F.lit(0.0)


def rough_walk_minutes(metres: Column) -> Column:
    return metres / 50.0


def wind_limit(size: Column) -> Column:
    """Operating limit by aircraft class, with the general limit for anything else."""
    table = F.create_map(*[F.lit(x) for pair in P.WIND_LIMIT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, size), F.lit(P.WIND_LIMIT_DEFAULT))
