"""Web-mercator tiles, quadkeys and grids as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geoquarry.functions.geo import MAX_LAT


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), F.lit(n - 1))


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    r = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * n), F.lit(0)), F.lit(n - 1))


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """One digit a zoom level: bit of x plus twice the bit of y, highest first."""
    digit = lambda i: (F.shiftright(x, i).bitwiseAND(F.lit(1)) + F.shiftright(y, i).bitwiseAND(F.lit(1)) * 2).cast("string")
    return F.concat(*[digit(i) for i in range(zoom - 1, -1, -1)])


def tile_west(x: Column, zoom: int) -> Column:
    return x / (1 << zoom) * 360 - 180


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / (1 << zoom)))))


def hilbert(x: Column, y: Column, zoom: int) -> Column:
    """Position along the Hilbert curve of a zoom level, offset by the tiles of all lower zooms."""
    start = F.struct(F.lit(((1 << (2 * zoom)) - 1) // 3).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(t, s):
        rx, ry = (t["x"] >= s).cast("long"), (t["y"] >= s).cast("long")
        d = t["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        px, py = t["x"] - rx * s, t["y"] - ry * s
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - px).otherwise(px), F.when(flip, s - 1 - py).otherwise(py)
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    sides = F.array(*[F.lit(1 << a).cast("long") for a in range(zoom - 1, -1, -1)])
    return F.aggregate(sides, start, step, lambda t: t["d"])
