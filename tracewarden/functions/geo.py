"""Column functions on coordinates: distances, web Mercator, grid cells, interpolation. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius of the haversine distance, the rounder one of the displacement measures, and the Mercator sphere.
EARTH_KM, EARTH_KM_ROUND, SPHERE_M = 6371.0088, 6371.0, 6378137.0


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lon1, lat1, lon2, lat2, radius: float = EARTH_KM) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(c(x)) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def euclidean(lon1, lat1, lon2, lat2) -> Column:
    """Distance in degrees."""
    return F.sqrt(F.pow(c(lon1) - c(lon2), 2) + F.pow(c(lat1) - c(lat2), 2))


def seconds_between(ts1, ts2) -> Column:
    return F.abs(c(ts1) - c(ts2))


def space_time(lon1, lat1, ts1, lon2, lat2, ts2) -> Column:
    """Degrees and seconds mixed without weights."""
    return F.sqrt(F.pow(c(lon1) - c(lon2), 2) + F.pow(c(lat1) - c(lat2), 2) + F.pow(c(ts1) - c(ts2), 2))


def space_time_weighted(lon1, lat1, ts1, lon2, lat2, ts2, weight) -> Column:
    """As space_time, with seconds scaled by weight."""
    return F.sqrt(F.pow(c(lon1) - c(lon2), 2) + F.pow(c(lat1) - c(lat2), 2) + F.pow(c(weight) * (c(ts1) - c(ts2)), 2))


def mercator_x(lon) -> Column:
    return SPHERE_M * F.radians(c(lon))


def mercator_y(lat) -> Column:
    return SPHERE_M * F.log(F.tan(math.pi / 4 + F.radians(c(lat)) / 2))


def inverse_lon(x) -> Column:
    return F.degrees(c(x) / SPHERE_M)


def inverse_lat(y) -> Column:
    return F.degrees(2 * F.atan(F.exp(c(y) / SPHERE_M)) - math.pi / 2)


def interpolate(x1, t1, x2, t2, t) -> Column:
    """The value at t on the line through (t1, x1) and (t2, x2)."""
    u = (c(t) - c(t1)) / (c(t2) - c(t1))
    return (1 - u) * c(x1) + u * c(x2)


def inclusive_range(a, b, step) -> Column:
    return F.sequence(c(a) if not isinstance(a, int) else F.lit(a), c(b) if not isinstance(b, int) else F.lit(b), F.lit(step))


def outside(lon, lat, box: tuple[float, float, float, float]) -> Column:
    """Outside the closed box (min_lon, min_lat, max_lon, max_lat)."""
    return ~(c(lon).between(box[0], box[2]) & c(lat).between(box[1], box[3]))
