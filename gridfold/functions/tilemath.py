"""Web Mercator tile arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def world_x(lng: Column) -> Column:
    """Longitude as a fraction 0..1 of the world square."""
    return (lng + 180) / 360


def world_y(lat: Column) -> Column:
    """Latitude as a fraction 0..1 of the world square, north first."""
    rad = F.radians(lat)
    return (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / PI) / 2


def grid(z: Column) -> Column:
    """Tiles per axis at a zoom."""
    return F.pow(F.lit(2.0), z)


def _clamp(t: Column, z: Column) -> Column:
    return F.greatest(F.lit(0), F.least(t, grid(z).cast("bigint") - 1))


def tile_of(lng: Column, lat: Column, z: Column) -> Column:
    """Tile (x, y) holding a position, clamped to the grid."""
    n = grid(z)
    return F.struct(
        _clamp(F.floor(world_x(lng) * n), z).alias("x"),
        _clamp(F.floor(world_y(lat) * n), z).alias("y"),
    )


def tile_range(bbox: Column, z: Column) -> Column:
    """Inclusive tile range of an envelope."""
    n = grid(z)
    last = n.cast("bigint") - 1
    return F.struct(
        F.greatest(F.lit(0), F.floor(world_x(bbox["xmin"]) * n)).alias("xmin"),
        F.greatest(F.lit(0), F.floor(world_y(bbox["ymax"]) * n)).alias("ymin"),
        F.least(last, F.floor(world_x(bbox["xmax"]) * n)).alias("xmax"),
        F.least(last, F.floor(world_y(bbox["ymin"]) * n)).alias("ymax"),
    )


def tile_bounds(x: Column, y: Column, z: Column) -> Column:
    """Envelope of a tile in degrees."""
    n = grid(z)
    lat = lambda row: F.degrees(F.atan(F.sinh(PI * (1 - 2 * row / n))))
    return F.struct(
        (x / n * 360 - 180).alias("xmin"),
        lat(y + 1).alias("ymin"),
        ((x + 1) / n * 360 - 180).alias("xmax"),
        lat(y).alias("ymax"),
    )


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Position on the Hilbert curve of the zoom, after all tiles of lower zooms."""
    before = ((grid(2 * z) - 1) / 3).cast("bigint")
    state = lambda d, a, b: F.struct(d.alias("d"), a.alias("x"), b.alias("y"))

    def step(s: Column, side: Column) -> Column:
        rx = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("bigint")
        ry = F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("bigint")
        d = s["d"] + side * side * (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, side - 1 - s["x"].bitwiseAND(side - 1)).otherwise(s["x"].bitwiseAND(side - 1))
        fy = F.when(flip, side - 1 - s["y"].bitwiseAND(side - 1)).otherwise(s["y"].bitwiseAND(side - 1))
        return state(d, F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy))

    sides = F.transform(
        F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("bigint")
    )
    start = state(F.lit(0).cast("bigint"), x.cast("bigint"), y.cast("bigint"))
    return before + F.when(z == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(sides, start, step, lambda s: s["d"]))
