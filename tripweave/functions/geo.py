"""Geodesic and planar expressions on lng/lat DOUBLE columns, all in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide the results and must stay as they are.
EARTH_RADIUS_M = 6378137.0
METRES_PER_DEGREE = (24901 * 1609) / 360.0
SNAP_M = 10.0

_RAD = math.pi / 180


def _d(value: float) -> Column:
    return F.lit(float(value))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    half_lat = F.sin((lat1 - lat2) * _d(_RAD) / 2)
    half_lng = F.sin((lng1 - lng2) * _d(_RAD) / 2)
    a = half_lat * half_lat + F.cos(lat2 * _d(_RAD)) * F.cos(lat1 * _d(_RAD)) * half_lng * half_lng
    return _d(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit_vector(lng: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The position on a sphere of radius 1."""
    x, y = lng * _d(_RAD), lat * _d(_RAD)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def half_height_deg(radius_m: float) -> float:
    """Latitude half-extent of the box around a point."""
    return 1 / METRES_PER_DEGREE * radius_m


def half_width_deg(lat: Column, radius_m: float) -> Column:
    """Longitude half-extent of the box around a point at ``lat``."""
    return 1 / (_d(METRES_PER_DEGREE) * F.cos(lat * _d(_RAD))) * _d(radius_m)


def in_box(lng: Column, lat: Column, c_lng: Column, c_lat: Column, radius_m: float) -> Column:
    """Inside the box around (c_lng, c_lat), bounds included (G1)."""
    h = _d(half_height_deg(radius_m))
    w = half_width_deg(c_lat, radius_m)
    return (lng >= c_lng - w) & (lng <= c_lng + w) & (lat >= c_lat - h) & (lat <= c_lat + h)


def point_to_segment(a: Column, b: Column, c: Column) -> Column:
    """Distance of a point to a segment.

    ``a`` and ``b`` are the point's distances to the two ends, ``c`` the segment's length.  Points
    within 10 m of an end count as on it, and a segment shorter than 10 m counts as its first end.
    """
    half = (a + b + c) / 2
    height = 2 * F.sqrt(F.greatest(half * (half - a) * (half - b) * (half - c), _d(0))) / c
    snap = _d(SNAP_M)
    return (
        F.when((a < snap) | (b < snap), _d(0))
        .when(c < snap, a)
        .when(a * a >= b * b + c * c, b)
        .when(b * b >= a * a + c * c, a)
        .otherwise(height)
    )
