"""The plane (EPSG:3857), its tiles and their pixels, as Column expressions.

Encoding and decoding use two origins on purpose: tiles are assigned with the truncated half width HALF, decoded
points start from pi * RADIUS and one unit of the 2^32 grid lower in y.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the coordinate model.
HALF = 20037508.3428
RADIUS = 6378137.0
EXTENT = 4096
UNITS = 256
FAR = 4e7

_GRID = 2147483648.0  # 2^31


def _c(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def tile_width(z: int) -> float:
    return 2 * HALF / (1 << z)


def scale(z: int) -> float:
    """Metres of one pixel of a tile."""
    return 2 * HALF / (1 << (z + 12))


def finite(v: Column | str) -> Column:
    """Coordinates that are infinite or not a number count as far outside, on the positive side."""
    v = _c(v).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(FAR)).otherwise(v)


def tile_x(gx: Column | str, z: int) -> Column:
    return ((finite(gx) + F.lit(HALF)) / F.lit(tile_width(z))).cast("long")


def tile_y(gy: Column | str, z: int) -> Column:
    return ((F.lit(HALF) - finite(gy)) / F.lit(tile_width(z))).cast("long")


def _round_away(v: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.round(v).cast("long")


def local_x(gx: Column | str, tx: Column | str, z: int) -> Column:
    """0 to 256 from the left edge of the tile."""
    return (finite(gx) - (_c(tx) * F.lit(tile_width(z)) - F.lit(HALF))) / F.lit(2 * HALF / ((1 << z) * float(UNITS)))


def local_y(gy: Column | str, ty: Column | str, z: int) -> Column:
    """0 to 256 from the upper edge of the tile."""
    return ((F.lit(HALF) - _c(ty) * F.lit(tile_width(z))) - finite(gy)) / F.lit(2 * HALF / ((1 << z) * float(UNITS)))


def pixel(local: Column) -> Column:
    """0 to 4096; 4096 itself stays in this tile."""
    return _round_away(local * F.lit(float(EXTENT)) / F.lit(float(UNITS)))


def origin_x(tx: Column | str, z: int) -> Column:
    """Left edge of a tile for decoding."""
    return (_c(tx) * F.lit(float(1 << (32 - z))) - F.lit(_GRID)) * F.lit(math.pi * RADIUS / _GRID)


def origin_y(ty: Column | str, z: int) -> Column:
    """Upper edge of a tile for decoding."""
    return (F.lit(4294967295.0) - _c(ty) * F.lit(float(1 << (32 - z))) - F.lit(_GRID)) * F.lit(math.pi * RADIUS / _GRID)


def global_x(tx: Column | str, px: Column | str, z: int) -> Column:
    return origin_x(tx, z) + F.lit(scale(z)) * _c(px)


def global_y(ty: Column | str, py: Column | str, z: int) -> Column:
    return origin_y(ty, z) - F.lit(scale(z)) * _c(py)


def longitude(x: Column | str) -> Column:
    return _c(x) / F.lit(RADIUS) * F.lit(180 / math.pi)


def latitude(y: Column | str) -> Column:
    return (F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(RADIUS))) - F.lit(math.pi / 2)) * F.lit(180 / math.pi)


def in_plane(gx: Column | str, gy: Column | str, z: int) -> Column:
    """True if the point's tile exists at this zoom."""
    tx, ty, n = tile_x(gx, z), tile_y(gy, z), 1 << z
    return (tx >= 0) & (tx < n) & (ty >= 0) & (ty < n)
