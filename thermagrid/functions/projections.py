"""Hammer and EASE-Grid coordinates as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half width and half height of the Hammer grid, and radius and true latitude of the equal-area grid.
HAMMER_X, HAMMER_Y = 18_000_000.0, 9_000_000.0
EASE_RADIUS, EASE_LATITUDE = 6_371_228.0, 30.0


def hammer_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees; coordinates beyond the edge fold back."""
    x = F.when(x > HAMMER_X, HAMMER_X - x).otherwise(x) / HAMMER_X
    y = F.when(y > HAMMER_Y, HAMMER_Y - y).otherwise(y) / HAMMER_Y
    z2 = 1 - x * x / 2 - y * y / 2
    z = F.when(z2 >= 0, F.sqrt(z2))
    lon = 2 * F.atan(math.sqrt(2) * x * z / (2 * z2 - 1))
    s = math.sqrt(2) * y * z
    return F.degrees(lon), F.degrees(F.when(F.abs(s) <= 1, F.asin(s)))


def hammer_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres."""
    lon = F.radians(F.when(lon > 180, lon - 360).otherwise(lon))
    lat = F.radians(lat)
    z = F.sqrt(1 + F.cos(lat) * F.cos(lon / 2))
    return F.cos(lat) * F.sin(lon / 2) / z * HAMMER_X, F.sin(lat) / z * HAMMER_Y


def grid_index(value: Column, origin: float, step: float, size: int | None, index: str = "floor", outside: str = "clamp") -> Column:
    """Cell of a coordinate.  outside: "clamp" takes the last cell, "null" none.  Without a size no cell is beyond the edge
    here: the join with the cells that the source has leaves out the others."""
    at = (value - origin) / step
    at = (F.floor(at) if index == "floor" else F.bround(at)).cast("int")
    if size is None:
        return at
    beyond = (at < 0) | (at >= size)
    return F.when(beyond, F.lit(size - 1) if outside == "clamp" else F.lit(None).cast("int")).otherwise(at)


def ease_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    k = math.cos(math.radians(EASE_LATITUDE))
    s = y * k / EASE_RADIUS
    return F.degrees(x / (EASE_RADIUS * k)), F.degrees(F.when(F.abs(s) <= 1, F.asin(s)))


def ease_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the cylindrical equal-area grid."""
    k = math.cos(math.radians(EASE_LATITUDE))
    return F.radians(lon) * (EASE_RADIUS * k), F.sin(F.radians(lat)) * (EASE_RADIUS / k)
